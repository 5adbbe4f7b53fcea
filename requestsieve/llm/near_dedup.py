"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight bytes. Fingerprints that differ in at most three bits share at least five
bytes in place. Postings are keyed by groups of byte positions with their values; the groups are
chosen so that any five positions contain one whole, so each close pair meets in a list. There
the shared positional bytes of a pair are tallied, pairs with at least five are kept and their
bits compared. A pair that shares several lists is made in the first of them only.

A list longer than `most_in_list` forms no pairs: its fingerprints are linked through meeting
points instead. Two fingerprints within three bits have a point one bit from the first and two
from the second; per point, the fingerprints within two bits are linked to one within one bit.
That is exact too, and grows with the list, not its square.
"""

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from requestsieve.llm.common import lookup, row_key, small_batches, written

BYTES = 8
MOST_BITS = 3
SHINGLE = 3
SEED = 42
LEAST_SHARED = BYTES - MOST_BITS
KEY_BYTES = 4
MOST_IN_LIST = 4096
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def position_groups(size: int = KEY_BYTES, within: int = LEAST_SHARED) -> list[tuple[int, ...]]:
    """Groups of `size` byte positions such that any `within` positions contain one; greedy."""
    open_sets = [set(c) for c in combinations(range(BYTES), within)]
    groups = []
    while open_sets:
        best = max(
            combinations(range(BYTES), size), key=lambda g: sum(s.issuperset(g) for s in open_sets)
        )
        groups.append(best)
        open_sets = [s for s in open_sets if not s.issuperset(best)]
    return groups


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the hashes of the shingles; no words: 0.

    Hashes are summed in blocks, so memory does not grow with the text beyond its words.
    """
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    last = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_digest
    sums = np.zeros(64, dtype=np.int64)
    for a in range(0, last, 20_000):
        hashed = b"".join(
            [digest(b" ".join(words[i : i + size]), SEED) for i in range(a, min(last, a + 20_000))]
        )
        bits = np.unpackbits(np.frombuffer(hashed, dtype=np.uint8).reshape(-1, BYTES), axis=1)
        sums += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > last).tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def _byte(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, 8 * k).bitwiseAND(F.lit(255))


def _masked(value: Column, group: tuple[int, ...]) -> Column:
    mask = sum(255 << (8 * k) for k in group)
    return value.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def postings(prints: DataFrame, groups: list[tuple[int, ...]]) -> DataFrame:
    """(slot, value, fp): each fingerprint under each group of positions."""
    keys = F.array(
        *[
            F.struct(F.lit(k).alias("slot"), _masked(F.col("fp"), g).alias("value"))
            for k, g in enumerate(groups)
        ]
    )
    return prints.select("fp", F.explode(keys).alias("key")).select("fp", "key.slot", "key.value")


def _first_group(shared: Column, groups: list[tuple[int, ...]]) -> Column:
    """The first group within the shared positions, given as bits; a table of 256 entries."""
    first = []
    for bits in range(256):
        own = [k for k, g in enumerate(groups) if all(bits >> p & 1 for p in g)]
        first.append(own[0] if own else -1)
    return F.get(F.lit(first), shared.cast("int"))


def close_pairs(lists: DataFrame, groups: list[tuple[int, ...]]) -> DataFrame:
    """(a, b) of fingerprints that meet in a list and differ in at most three bits, a < b.

    `lists` has slot, value, fp and `listed`, the length of the list.
    """
    left, right = lists.alias("l"), lists.alias("r")
    differs = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    same = [F.when(_byte(differs, k) == 0, 1).otherwise(0) for k in range(BYTES)]
    tally = sum(same[1:], same[0])
    bits = sum((same[k] * F.lit(1 << k) for k in range(1, BYTES)), same[0])
    return left.join(
        right,
        (F.col("l.slot") == F.col("r.slot"))
        & (F.col("l.value") == F.col("r.value"))
        & (F.col("l.fp") < F.col("r.fp"))
        & (tally >= LEAST_SHARED)
        & (F.bit_count(differs) <= MOST_BITS)
        & (_first_group(bits, groups) == F.col("l.slot")),
    ).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def meeting_links(prints: DataFrame) -> DataFrame:
    """(a, b) links that connect all fingerprints within three bits, through meeting points."""
    def flips(n: int) -> list[int]:
        masks = [sum(1 << k for k in c) for c in combinations(range(64), n)]
        return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]

    near = F.transform(F.lit([0, *flips(1)]), lambda m: F.col("fp").bitwiseXOR(m))
    wide = F.transform(F.lit([0, *flips(1), *flips(2)]), lambda m: F.col("fp").bitwiseXOR(m))
    hubs = (
        prints.select("fp", F.explode(near).alias("point"))
        .groupBy("point")
        .agg(F.min("fp").alias("a"))
    )
    around = prints.select(F.col("fp").alias("b"), F.explode(wide).alias("point"))
    return hubs.join(around, "point").filter("a != b").select("a", "b").distinct()


def links(prints: DataFrame, most_in_list: int = MOST_IN_LIST) -> DataFrame:
    """(a, b) links between different fingerprints whose components are those of all close pairs.

    `prints` has one row per fingerprint (`fp`) and is read again.
    """
    groups = position_groups()
    lengths = (
        postings(prints, groups)
        .groupBy("slot", "value")
        .agg(F.count(F.lit(1)).alias("listed"))
        .filter("listed > 1")
    )
    lists = written(postings(prints, groups).join(lengths, ["slot", "value"]), "lists")
    pairs = close_pairs(lists.filter(F.col("listed") <= most_in_list), groups)
    crowded = lists.filter(F.col("listed") > most_in_list).select("fp").distinct()
    if crowded.isEmpty():
        return pairs
    return pairs.union(meeting_links(crowded))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root) for every node: one root for each connected component.

    Each round every node joins the neighbour of least hash, if that is less than its own, and
    edges move to where their ends went; a hash of the round keeps chains short. Rounds end
    when no edge is left, and every round is kept on shared storage.
    """
    rest = written(
        edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), "edges"
    )
    moves, round_no = [], 0
    while not rest.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(round_no), c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        step = written(
            rest.groupBy("a")
            .agg(F.min(order("b")).alias("least"))
            .select(
                "a",
                F.when(F.col("least") < order("a"), F.col("least.n")).otherwise(F.col("a")).alias("to"),
            ),
            "moves",
        )
        moves.append(step)
        other = step.select(F.col("a").alias("b"), F.col("to").alias("b_to"))
        rest = written(
            rest.join(step, "a")
            .join(other, "b")
            .filter("to != b_to")
            .select(F.col("to").alias("a"), F.col("b_to").alias("b"))
            .distinct(),
            "edges",
        )
        round_no += 1
    found = nodes.select("fp", F.col("fp").alias("root"))
    for step in moves:
        found = (
            found.join(step.withColumnRenamed("a", "root"), "root", "left")
            .select("fp", F.coalesce("to", "root").alias("root"))
        )
    return found


def classes(rows: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per fingerprint of `rows` (fp, __rs_id, __rs_row): number of rows, and its component's
    least (doc_id, row hash). `links_of` takes the fingerprints with their rows and least."""
    prints = written(
        rows.groupBy("fp").agg(
            F.count(F.lit(1)).alias("rows"), F.min(F.struct("__rs_id", "__rs_row")).alias("least")
        ),
        "prints",
    )
    edges = written(links_of(prints), "links")
    rooted = prints.join(components(prints.select("fp"), edges), "fp")
    roots = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return written(rooted.join(roots, "root").select("fp", "rows", "first"), "classes")


def _prints(docs: DataFrame) -> DataFrame:
    return written(
        small_batches(docs).select("doc_id", *row_key(), fingerprints("text").alias("fp")), "fingerprints"
    )


def _classes(rows: DataFrame, most_in_list: int) -> DataFrame:
    return classes(rows, lambda prints: links(prints.select("fp"), most_in_list))


def near_duplicates(docs: DataFrame, most_in_list: int = MOST_IN_LIST) -> DataFrame:
    """Per row: doc_id, fingerprint and component_id, the smallest doc_id it can reach.

    Null and empty texts have fingerprint zero, which is linked like any other. A null doc_id
    counts as the least number there is. Repeated rows each get their row; no rows give none.
    """
    rows = _prints(docs)
    found = lookup(rows, _classes(rows, most_in_list), "fp", "rows", ["first"], F.col("__rs_row"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.__rs_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, most_in_list: int = MOST_IN_LIST) -> DataFrame:
    """The row with the smallest doc_id of each component, with the columns of `docs`.

    Rows that tie in id and text are one document.
    """
    rows = _prints(docs)
    return first_of_class(docs, rows, _classes(rows, most_in_list))


def first_of_class(docs: DataFrame, rows: DataFrame, found_classes: DataFrame) -> DataFrame:
    """The rows of `docs` that are the first of their class; `rows` has their fingerprints."""
    found = lookup(rows, found_classes, "fp", "rows", ["first"], F.col("__rs_row"))
    stays = found.filter(F.col("first") == F.struct("__rs_id", "__rs_row"))
    counted = stays.groupBy("__rs_id", "__rs_row").agg(F.count(F.lit(1)).alias("__rs_n"))
    chosen = written(counted, "stays")
    keyed = docs.withColumns({c: e for c, e in zip(("__rs_id", "__rs_row"), row_key(), strict=True)})
    left = keyed.join(chosen, ["__rs_id", "__rs_row"])
    if chosen.filter("__rs_n > 1").isEmpty():
        return left.select(docs.columns)
    return left.dropDuplicates(["__rs_id", "__rs_row"]).select(docs.columns)
