"""Best-fit decreasing packing of token pieces into sequences of fixed capacity.

Best fit depends on lengths alone, and there are no more lengths than tokens in a sequence. So
the counts of pieces by length are packed, longest first: a segment tree over remaining
capacities finds the tightest open sequences in logarithmic time, and all pieces of one length
that go to sequences with the same room are placed at once. The outcome is that of placing the
documents one by one. Each placement covers a run of ranks among pieces of its length; pieces
are ranked in parallel and joined with their places by (length, rank).
"""

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requestsieve.llm.common import chunk_bits, running, small_batches, written
from requestsieve.llm.tokens import parts, tokenizer

CAPACITY = 4096
END = 1
PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
)
PLACES = ["length", "rank", "pieces", "sequence", "each", "offset"]
# Pieces of one placement that a task writes out.
PLACED_AT_ONCE = 50_000


class Room:
    """Open sequences by remaining capacity; a segment tree finds the least room that suffices."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.runs: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def _change(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += n
            k >>= 1

    def put(self, room: int, first: int, n: int, ahead: bool = False) -> None:
        """Sequences `first` and on, `n` in all, have this much room."""
        if n:
            (self.runs[room].appendleft if ahead else self.runs[room].append)((first, n))
            self._change(room, n)

    def take(self, room: int) -> tuple[int, int]:
        first, n = self.runs[room].popleft()
        self._change(room, -n)
        return first, n

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least `least` that some sequence has."""
        k = least + self.leaves
        if self.count[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.count[k + 1]:
                k += 1
                break
            k >>= 1
        else:
            return None
        while k < self.leaves:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit(counts: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple]:
    """Placements (length, rank, pieces, sequence, each, offset) for (length, number) counts.

    Pieces `rank` and on of this length go to sequences `sequence` and on, `each` to one, the
    first of them at `offset`.
    """
    room, used, placed = Room(capacity), 0, []
    for length, left in sorted(counts, reverse=True):
        rank = 0
        while left:
            free = room.tightest(length)
            if free is None:
                n = -(-left // (capacity // length))
                room.put(capacity, used, n)
                used += n
                free = capacity
            first, n = room.take(free)
            each = min(free // length, left)
            filled = min(n, left // each)
            placed.append((length, rank, filled * each, first, each, capacity - free))
            room.put(free, first + filled, n - filled, ahead=True)
            room.put(free - each * length, first, filled)
            rank += filled * each
            left -= filled * each
    return placed


def pieces(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    spaced: bool = False,
    end: int = END,
    keep_ids: bool = True,
) -> DataFrame:
    """Documents as token ids with an end id, cut where they are longer than the capacity.

    Null texts are empty and have the end id alone. `ids` are little-endian unsigned 32-bit, null
    unless kept.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, spaced).encode
        for batch in batches:
            texts = batch.column("text")
            for a, n in parts(texts):
                ids, ends = encode(texts.slice(a, n))
                ids = np.insert(ids, ends, end).astype("<u4")
                ends = ends + np.arange(1, n + 1)
                sizes = np.diff(ends, prepend=0)
                number = -(-sizes // capacity)
                doc = np.repeat(np.arange(n), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                at = (ends - sizes)[doc] + start
                raw = memoryview(ids.tobytes())
                own = [
                    raw[4 * x : 4 * (x + m)] for x, m in zip(at.tolist(), length.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, n).take(pa.array(doc)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([zlib.crc32(x) for x in own], pa.int64()),
                        pa.array([bytes(x) for x in own] if keep_ids else [None] * len(own), pa.binary()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return small_batches(rows).mapInArrow(cut, PIECES)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (with doc_id, piece and length) with sequence_id and offset of every piece.

    `cut` is read twice, so it should be written. Repeated rows are pieces of their own. Pieces
    of one length are ranked in chunks of a hash, so a length that most documents have is many
    tasks. The driver holds the counts by length and their placements, whose number does not
    grow with the documents beyond a bound set by the capacity.
    """
    spark = cut.sparkSession
    counts = cut.groupBy("length").count().collect()
    placed = best_fit([(r["length"], r["count"]) for r in counts], capacity)
    frame = pd.DataFrame(placed, columns=PLACES, dtype="int64")
    blocks = F.sequence(F.lit(0), F.floor((F.col("pieces") - 1) / PLACED_AT_ONCE))
    within = F.sequence(
        F.col("block") * PLACED_AT_ONCE,
        F.least(F.col("pieces"), (F.col("block") + 1) * PLACED_AT_ONCE) - 1,
    )
    places = (
        spark.createDataFrame(frame, ", ".join(f"{c} bigint" for c in PLACES))
        .withColumn("block", F.explode(blocks))
        .repartition("length", "rank", "block")
        .withColumn("k", F.explode(within))
        .select(
            "length",
            (F.col("rank") + F.col("k")).alias("__rs_rank"),
            (F.col("sequence") + F.floor(F.col("k") / F.col("each"))).alias("sequence_id"),
            (F.col("offset") + F.col("k") % F.col("each") * F.col("length")).alias("offset"),
        )
    )
    bits = chunk_bits(spark)
    mixed = F.xxhash64("doc_id", "piece")
    rows = cut.withColumns(
        {"__rs_mixed": mixed, "__rs_chunk": F.shiftrightunsigned(mixed, 64 - bits), "__rs_one": F.lit(1)}
    )
    ranked = running(
        rows, ["length"], "__rs_chunk", ["__rs_mixed", "doc_id", "piece"], "__rs_one"
    )
    return ranked.join(places, ["length", "__rs_rank"]).select(
        *cut.columns, "sequence_id", "offset"
    )


def pack_documents(docs: DataFrame, path: str, keep_ids: bool = False, **options) -> DataFrame:
    """Every piece of every document with its place; ids only where asked for."""
    cut = pieces(docs, path, keep_ids=keep_ids, **options)
    kept = written(cut if keep_ids else cut.drop("ids"), "pieces")
    return pack(kept, options.get("capacity", CAPACITY))
