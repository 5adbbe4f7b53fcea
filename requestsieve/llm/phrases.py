"""Phrase collocations by an FM-index of each shard over word ids.

A shard is a million words or two. Its suffixes are sorted by their first `MOST_WORDS` words
within their piece; the index is the word before each suffix in that order (the transform), and
how often each word occurs. Both are enough to step from an interval of suffixes that begin with
a phrase to that of the phrase with one more word on its left. Such a longer phrase lies within
the interval of its first words too, of which it is a right extension; so a step takes phrases
whose two shorter halves are frequent in the whole corpus, and no others.

Each length is one pass: shards extend the intervals that are left, counts are added up over
shards, and intervals of frequent phrases go back to their shards. Counts travel in blocks of a
hash of the phrase, each a few packed columns for a shard; there are so many blocks that one
holds about a million counts of all shards together. The index table is bucketed by shard, so it
is not shuffled. A phrase is frequent if it occurs `least` times in its language;
its parts then are too, so nothing that counts is left out.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from requestsieve.llm.common import small_batches, written
from requestsieve.llm.tokens import give_back, parts
from requestsieve.session import shared_folder

MOST_WORDS = 4
LEAST = 30
TOP = 2000
COVERED_PERCENT = 80
SCALE = 2_000_000
SHARD_WORDS = 1_500_000
SHARDS_PER_TASK = 1024

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD, BLANK, BREAK = range(3)
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[ord(c) for c in ".,;:!?"]] = BREAK
KIND[0x0A:0x0E] = BREAK

INDEX = (
    "shard bigint, transform binary, words array<string>, langs array<string>,"
    " starts array<bigint>, counts array<bigint>"
)
LOCAL = "block bigint, shard bigint, size bigint, packed binary"
# Rows of two kinds: a frequent phrase, or (with `shard`) intervals that stay in a shard.
SUMMED = (
    "id bigint, prefix bigint, suffix bigint, a bigint, shard bigint, size bigint, packed binary"
)
BLOCK_COUNTS = 1_000_000
CODEC = "zstd"


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """All words, A-Z in lower case; whether each begins a piece; and the number of each text.

    Texts are not null.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    raw = LOWER[raw]
    kind = KIND[raw]
    inside = kind == WORD
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True  # a text begins
    begins = np.flatnonzero(inside & (first[:-1] | np.append(True, ~inside)[:-1]))
    kept = np.cumsum(inside, dtype=np.int64)
    own = np.append(kept[begins] - 1, kept[-1] if len(kept) else 0)
    buffers = [None, pa.py_buffer(own), pa.py_buffer(raw[inside])]
    words = pa.Array.from_buffers(pa.large_string(), len(begins), buffers).dictionary_encode()
    before = np.searchsorted(begins, offsets)
    breaks = np.cumsum(kind == BREAK)[begins]
    opens = np.diff(breaks, prepend=-1) > 0
    opens[before[:-1][before[:-1] < len(begins)]] = True
    return words, opens, np.diff(before)


def suffix_order(symbols: np.ndarray, left: np.ndarray, most: int = MOST_WORDS) -> np.ndarray:
    """Places in the order of their next `most` symbols, as far as there are any; ties by place.

    Symbols are 1 and up; `left` is the number that follow each within its piece.
    """
    rank, depth, order = symbols.astype(np.int32), 1, None
    while order is None or depth < most:
        key = rank.astype(np.int64) * (int(rank.max(initial=0)) + 1)
        on = np.flatnonzero(left >= depth)
        key[on] += rank[on + depth]
        del on
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.diff(key[order], prepend=-1) > 0)
        depth *= 2
    return order


def transform(symbols: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The symbol before each suffix, suffixes in order; 0 before the first of a piece."""
    n = len(symbols)
    edges = np.append(np.flatnonzero(opens), n)
    left = (np.repeat(edges[1:], np.diff(edges)) - np.arange(n) - 1).astype(np.int32)
    order = suffix_order(symbols, left)
    before = np.where(opens, 0, np.roll(symbols, 1)).astype("<u4")
    return before[order]


def left_steps(bwt: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each suffix the one with the word before it added; meaningless where there is none.

    Among suffixes that begin with a word, those that end with it come first; then the i-th
    suffix with the word before it leads to the i-th of them.
    """
    order = np.argsort(bwt, kind="stable")
    place = np.empty(len(bwt), dtype=np.int64)
    place[order] = np.arange(len(bwt))
    listed = np.bincount(bwt, minlength=len(counts) + 1)
    target = np.cumsum(counts) - listed[1:]
    return place + np.append(0, target - (np.cumsum(listed) - listed)[1:])[bwt]


def extend(
    bwt: np.ndarray, counts: np.ndarray, lo: np.ndarray, n: np.ndarray, ids: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Extensions by one word of the phrases with these intervals, both halves among them.

    Returns the phrase's first words and last words (their ids), its interval's start and size.
    """
    owner = np.full(len(bwt), -1, dtype=np.int32)
    rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    owner[rows] = np.repeat(np.arange(len(lo)), n)
    rows = rows[bwt[rows] > 0]
    to = left_steps(bwt, counts)[rows]
    own = owner[to] >= 0
    to, suffix = to[own], owner[rows[own]]
    order = np.argsort(to)
    to, suffix = to[order], suffix[order]
    prefix = owner[to]
    new = (np.diff(prefix, prepend=-1) != 0) | (np.diff(suffix, prepend=-1) != 0)
    first = np.flatnonzero(new)
    return ids[prefix[first]], ids[suffix[first]], to[first], np.diff(np.append(first, len(to)))


class Shard:
    """Words of texts until they are enough for an index."""

    def __init__(self):
        self.parts: list[tuple[pa.DictionaryArray, np.ndarray, np.ndarray]] = []
        self.langs: dict[str, int] = {}
        self.size = 0

    def add(self, texts: pa.Array, langs: pa.Array) -> None:
        words, opens, counts = words_of(texts)
        codes = [self.langs.setdefault(x, len(self.langs)) for x in langs.to_pylist()]
        self.parts.append((words, opens, np.repeat(np.array(codes, dtype=np.int32), counts)))
        self.size += len(words)

    def indexes(self, most: int) -> Iterator[tuple]:
        """Index rows without their shard number; cut between pieces where words are too many."""
        if not self.size:
            return
        chunks = pa.chunked_array([p[0] for p in self.parts]).unify_dictionaries().chunks
        names = chunks[0].dictionary
        ids = np.concatenate([c.indices.to_numpy() for c in chunks])
        opens, langs = (np.concatenate([p[k] for p in self.parts]) for k in (1, 2))
        self.parts, chunks = [], []
        at = np.flatnonzero(opens)
        edges = at[np.diff(at // most, prepend=0) > 0] if self.size >= 2 * most else at[:0]
        by_code = pa.array(list(self.langs), pa.string())
        for a, b in zip([0, *edges], [*edges, len(ids)], strict=True):
            keys = langs[a:b].astype(np.int64) * len(names) + ids[a:b]
            found, symbols, counts = np.unique(keys, return_inverse=True, return_counts=True)
            del keys
            yield (
                transform(symbols.astype(np.int32) + 1, opens[a:b]),
                names.take(pa.array(found % len(names))),
                by_code.take(pa.array(found // len(names))),
                np.cumsum(counts) - counts,
                counts,
            )


def write_index(
    docs: DataFrame, text: str = "text", lang: str = "lang", shard_words: int = SHARD_WORDS
) -> str:
    """Index all documents; returns the name of a table, bucketed by shard, one row each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * SHARDS_PER_TASK
        last = number + SHARDS_PER_TASK

        def rows(shard: Shard) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for raw, words, langs, starts, counts in shard.indexes(shard_words):
                if number == last:
                    raise ValueError("a task has too many words; read smaller partitions")
                lists = [
                    words.cast(pa.string()), langs, *[pa.array(v, pa.int64()) for v in (starts, counts)]
                ]
                whole = pa.Array.from_buffers(
                    pa.binary(),
                    1,
                    [None, pa.py_buffer(np.array([0, raw.nbytes], np.int32)), pa.py_buffer(raw)],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        whole,
                        *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists],
                    ],
                    ["shard", "transform", "words", "langs", "starts", "counts"],
                )
                number += 1
                give_back()

        shard = Shard()
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1)
            for a, n in parts(texts):
                shard.add(texts.slice(a, n), langs.slice(a, n))
                if shard.size >= shard_words:
                    yield from rows(shard)
                    shard = Shard()
        yield from rows(shard)

    spark = docs.sparkSession
    name = f"phrase_index_{uuid.uuid4().hex}"
    texts = docs.select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang")
    )
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        small_batches(texts)
        .mapInArrow(build, INDEX)
        .write.bucketBy(buckets, "shard")
        .option("path", shared_folder(spark, "phrase-index"))
        .saveAsTable(name)
    )
    return name


def _pack(*columns: np.ndarray) -> bytes:
    """Whole-number columns of one length; the first is in rising order and kept by its steps."""
    first = np.diff(columns[0], prepend=0)
    wide = [np.ascontiguousarray(c, dtype="<i8").view(np.uint8).reshape(-1, 8).T for c in (first, *columns[1:])]
    return pa.compress(np.concatenate(wide).tobytes(), CODEC, asbytes=True)


def _unpack(packed: pa.Buffer, size: int, count: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(packed, 8 * size * count, CODEC), np.uint8).reshape(count, 8, size)
    columns = [np.ascontiguousarray(c.T).view("<i8").ravel() for c in raw]
    return [np.cumsum(columns[0]), *columns[1:]]


def _block(prefix: np.ndarray, suffix: np.ndarray, blocks: int) -> np.ndarray:
    mixed = prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29)) ^ suffix.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(31)) % np.uint64(blocks)).astype(np.int64)


def _frequent_words(local: DataFrame, least: int) -> DataFrame:
    """Rows (a word in a shard) of words that all shards together hold `least` times; their sum
    is `a`. `id` is that of one of the word's intervals, the same for all its rows."""
    same = Window.partitionBy("lang", "phrase")
    own = F.shiftleft("shard", 32) + F.col("lo")
    summed = local.withColumns(
        {"own": own, "a": F.sum("n").over(same), "id": F.min(own).over(same)}
    )
    return written(summed.filter(F.col("a") >= least), "frequent")


def _extended(index: DataFrame, alive: DataFrame, blocks: int) -> DataFrame:
    """Per shard and block the phrases one word longer than those `alive` in the shard.

    `alive` has one row for each shard, with `intervals`: structs, or packed columns.
    """

    def intervals_of(value: pa.Scalar) -> list[np.ndarray]:
        entries = value.values
        if "packed" not in [f.name for f in entries.type]:
            return [entries.field(c).to_numpy() for c in ("lo", "n", "id")]
        sizes, packed = entries.field("size").to_pylist(), entries.field("packed")
        found = [_unpack(packed[k].as_buffer(), n, 3) for k, n in enumerate(sizes)]
        return [np.concatenate(c) for c in zip(*found, strict=True)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, raw, counts, intervals = (c[k] for c in batch.columns)
                lo, n, ids = intervals_of(intervals)
                order = np.argsort(lo)
                bwt = np.frombuffer(raw.as_buffer(), "<u4").astype(np.int32)
                own = counts.values.to_numpy()
                columns = extend(bwt, own, lo[order], n[order], ids[order])
                block = _block(*columns[:2], blocks)
                order = np.lexsort((columns[1], columns[0], block))
                columns, block = [c[order] for c in columns], block[order]
                edges = np.flatnonzero(np.diff(block, prepend=-1))
                ends = [*edges[1:], len(block)][: len(edges)]
                packed = [_pack(*[c[a:b] for c in columns]) for a, b in zip(edges, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block[edges], pa.int64()),
                        pa.array([shard.as_py()] * len(edges), pa.int64()),
                        pa.array(np.diff([*edges, len(block)]), pa.int64()),
                        pa.array(packed, pa.binary()),
                    ],
                    ["block", "shard", "size", "packed"],
                )
                give_back()

    joined = index.select("shard", "transform", "counts").join(alive, "shard")
    return small_batches(joined).mapInArrow(step, LOCAL)


def _summed(local: DataFrame, least: int) -> DataFrame:
    """The phrases that all shards together hold `least` times, and their intervals by shard."""
    kinds = [pa.int64()] * 6 + [pa.binary()]
    names = ["id", "prefix", "suffix", "a", "shard", "size", "packed"]

    def add_up(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        block, shards, sizes = (group.column(k).to_numpy() for k in ("block", "shard", "size"))
        packed = group.column("packed").chunk(0)
        found = [_unpack(packed[k].as_buffer(), n, 4) for k, n in enumerate(sizes.tolist())]
        prefix, suffix, lo, n = (np.concatenate(c) for c in zip(*found, strict=True))
        shard = np.repeat(shards, sizes)
        del found
        order = np.lexsort((suffix, prefix))
        first = np.flatnonzero(
            (np.diff(prefix[order], prepend=-1) != 0) | (np.diff(suffix[order], prepend=-1) != 0)
        )
        total = np.add.reduceat(n[order], first)
        frequent = total >= least
        ids = np.cumsum(frequent) - 1 + (int(block[0]) << 32)
        rows = order[np.repeat(frequent, np.diff(np.append(first, len(order))))]
        one = order[first[frequent]]
        phrases = pa.table(
            [pa.array(c, pa.int64()) for c in (ids[frequent], prefix[one], suffix[one], total[frequent])]
            + [pa.nulls(len(one), k) for k in kinds[4:]],
            names,
        )
        own_id = np.repeat(ids[frequent], np.diff(np.append(first, len(order)))[frequent])
        by_shard = np.lexsort((lo[rows], shard[rows]))
        rows, own_id = rows[by_shard], own_id[by_shard]
        edges = np.flatnonzero(np.diff(shard[rows], prepend=-1))
        ends = [*edges[1:], len(rows)][: len(edges)]
        packed = [
            _pack(lo[rows[a:b]], n[rows[a:b]], own_id[a:b]) for a, b in zip(edges, ends, strict=True)
        ]
        stay = pa.table(
            [pa.nulls(len(edges), k) for k in kinds[:4]]
            + [
                pa.array(shard[rows[edges]], pa.int64()),
                pa.array(np.diff([*edges, len(rows)]), pa.int64()),
                pa.array(packed, pa.binary()),
            ],
            names,
        )
        return pa.concat_tables([phrases, stay])

    return written(local.groupBy("block").applyInArrow(add_up, SUMMED), "summed")


def _longer(summed: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases of one more word: counts of all their beginnings (`heads`) and ends (`tails`)."""
    once = summed.filter("shard IS NULL").select("id", "prefix", "suffix", "a")
    p = shorter.select(*[F.col(c).alias(f"p_{c}") for c in ("id", "lang", "phrase", "a", "heads")])
    s = shorter.select(*[F.col(c).alias(f"s_{c}") for c in ("id", "last", "a", "tails")])
    return (
        once.join(p, F.col("prefix") == F.col("p_id"))
        .join(s, F.col("suffix") == F.col("s_id"))
        .select(
            "id",
            "prefix",
            "suffix",
            F.col("p_lang").alias("lang"),
            F.concat_ws(" ", "p_phrase", "s_last").alias("phrase"),
            F.col("s_last").alias("last"),
            "a",
            F.concat("p_heads", F.array("p_a")).alias("heads"),
            F.concat("s_tails", F.array("s_a")).alias("tails"),
        )
    )


def _covered(phrases: DataFrame, longer: DataFrame, percent: int) -> DataFrame:
    """`phrases` that no phrase one word longer covers, with the numbers of their extensions.

    A phrase of yet more words is rarer than one within it that is a word longer than this, so
    it covers nothing besides.
    """
    left, right = F.lit(1).alias("l"), F.lit(1).alias("r")
    none = F.lit(0)
    parts_of = F.array(
        F.struct(F.col("prefix").alias("id"), none.alias("l"), right),
        F.struct(F.col("suffix").alias("id"), left, none.alias("r")),
    )
    found = (
        longer.select("a", F.explode(parts_of).alias("part"))
        .groupBy("part.id")
        .agg(
            F.max("a").alias("most"),
            F.sum("part.l").alias("left_extensions"),
            F.sum("part.r").alias("right_extensions"),
        )
    )
    kept = phrases.join(found, "id", "left").filter(
        f"most IS NULL OR 100 * most < {int(percent)} * a"
    )
    return kept.fillna(0, ["left_extensions", "right_extensions"]).drop("most")


def _weakest_cut() -> Column:
    """score, k, l and r of the cut that scores lowest, the first of such; exact at any size."""
    score = f"(CAST(a AS DECIMAL(20, 0)) * {SCALE}) DIV"
    return F.expr(
        f"""array_min(transform(sequence(1, size(heads)), k -> named_struct(
          'score', {score} (heads[k - 1] + tails[size(heads) - k]),
          'k', k, 'l', heads[k - 1], 'r', tails[size(heads) - k])))"""
    )


def frequent_phrases(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    shard_words: int = SHARD_WORDS,
) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with the number of words, and phrases of 1 to `MOST_WORDS` words by length."""
    spark = docs.sparkSession
    name = write_index(docs, text, lang, shard_words)
    index = spark.table(name)
    words = index.select(
        "shard", F.inline(F.arrays_zip("words", "langs", "starts", "counts"))
    ).toDF("shard", "phrase", "lang", "lo", "n")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    blocks = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // BLOCK_COUNTS
    known = _frequent_words(words, least)
    none = F.array().cast("array<bigint>")
    found = [
        known.filter("id = own").select(
            "id", "lang", "phrase", F.col("phrase").alias("last"), "a", none.alias("heads"), none.alias("tails")
        )
    ]
    entry = F.struct("lo", "n", "id")
    alive = known
    for _ in range(MOST_WORDS - 1):
        by_shard = alive.groupBy("shard").agg(F.collect_list(entry).alias("intervals"))
        summed = _summed(_extended(index, by_shard, blocks), least)
        found.append(written(_longer(summed, found[-1]), "phrases"))
        alive, entry = summed.filter("shard IS NOT NULL"), F.struct("size", "packed")
    spark.sql(f"DROP TABLE {name}")
    return totals, found


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    percent: int = COVERED_PERCENT,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score, extensions.

    Null texts are empty, a null lang is `und`. Repeated rows count again. Equal scores go by
    a, then by the phrase's bytes. Texts without words and empty tables give no rows. Numbers of
    left and right extensions are those of frequent phrases one word longer; null at full length.
    """
    totals, (_, *phrases) = frequent_phrases(docs, text, lang, least, shard_words)
    kept = [_covered(p, longer, percent) for p, longer in zip(phrases, phrases[1:], strict=False)]
    unknown = F.lit(None).cast("long")
    kept.append(phrases[-1].withColumns({"left_extensions": unknown, "right_extensions": unknown}))
    columns = ["lang", "phrase", "a", "heads", "tails", "left_extensions", "right_extensions"]
    every = kept[0].select(columns)
    for more in kept[1:]:
        every = every.unionByName(more.select(columns))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    scored = every.withColumn("cut", _weakest_cut()).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "left_extensions", "right_extensions"
    )
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score", "left_extensions", "right_extensions"
    )
