"""Token-id files: one array of ids per shard, document boundaries in Elias-Fano coding.

A shard is two files. `.ids` holds the ids of its documents one after another, as little-endian
unsigned 16-bit or 32-bit numbers. `.idx` holds two rising sequences in Elias-Fano coding, the
end of each document in the array and the document ids: the low bits of a value are stored
as they are, its high bits in unary, and the place of every 64th one bit in 32 bits. Selecting
the i-th one bit gives the i-th value, so no table of 64-bit offsets is needed. A shard's place
among all ids is in the manifest, one row per shard.
"""

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from requestsieve.llm.common import small_batches, written
from requestsieve.llm.tokens import parts, tokenizer

END = 0
SAMPLE = 64
MAGIC = b"EFTI"
MANIFEST = "shard int, name string, n_docs bigint, n_ids bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
# Ids that are read at once.
READ = 4_000_000


@dataclass
class EliasFano:
    """A rising sequence of numbers from 0 on."""

    count: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        most = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (most // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8))
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low, np.packbits(high), ones[::SAMPLE].astype("<u4"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        value = np.zeros(len(i), dtype=np.uint64)
        for bit in range(self.low_bits):
            place = i * self.low_bits + bit
            own = (self.low[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
            value |= own.astype(np.uint64) << np.uint64(bit)
        return value

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, count one bits up to it."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place >> 3
        bits = self.high[byte] & (0xFF >> (place & 7))
        while (ones := int(bits).bit_count()) <= left:
            left -= ones
            byte += 1
            bits = self.high[byte]
        at = 8 * byte + int(np.flatnonzero(np.unpackbits(np.array([bits], dtype=np.uint8)))[left])
        return (at - i) << self.low_bits | int(self._low(np.array([i]))[0])

    def values(self) -> np.ndarray:
        every = np.arange(self.count)
        ones = np.flatnonzero(np.unpackbits(self.high))[: self.count]
        return ((ones - every).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(every)

    def to_bytes(self) -> bytes:
        sizes = (self.count, self.low_bits, len(self.low), len(self.high), len(self.samples))
        body = self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()
        return struct.pack("<5Q", *sizes) + body

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple["EliasFano", bytes]:
        """The sequence at the start of `raw`, and what follows it."""
        count, low_bits, low, high, samples = struct.unpack_from("<5Q", raw)
        at = 40
        cut = lambda n, kind="u1": np.frombuffer(raw, kind, n, at)
        own_low, at = cut(low), at + low
        own_high, at = cut(high), at + high
        own_samples, at = cut(samples, "<u4"), at + 4 * samples
        return cls(count, low_bits, own_low, own_high, own_samples), raw[at:]


def storage(folder: str) -> tuple[fs.FileSystem, str]:
    if ":" not in folder:
        return fs.LocalFileSystem(), folder
    scheme, rest = folder.split(":", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{rest}" if not rest.startswith("//") else folder)


def index_bytes(ends: np.ndarray, doc_ids: np.ndarray, nulls: int, id_bytes: int) -> bytes:
    """The index file: counts, the first doc_id, then both sequences; null ids come first."""
    base = int(doc_ids[0]) if len(doc_ids) else 0
    head = MAGIC + struct.pack("<QqQ", id_bytes, base, nulls)
    above = (doc_ids.astype(np.int64).view(np.uint64) - np.uint64(base % (1 << 64)))
    return head + EliasFano.encode(ends).to_bytes() + EliasFano.encode(above).to_bytes()


def read_index(raw: bytes) -> tuple[EliasFano, EliasFano, int, int, int]:
    """Ends, doc ids above the first, id_bytes, the first doc_id, and the number of null ids."""
    if raw[:4] != MAGIC:
        raise ValueError("not an index of token ids")
    id_bytes, base, nulls = struct.unpack_from("<QqQ", raw, 4)
    ends, rest = EliasFano.from_bytes(raw[28:])
    above, _ = EliasFano.from_bytes(rest)
    return ends, above, id_bytes, base, nulls


def write(docs: DataFrame, folder: str, path: str, spaced: bool = True, end: int = END) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; returns the manifest, written.

    Null texts are empty; a null doc_id comes first; repeated rows each have their ids. Rows are
    dealt by ranges of doc_id, and each task writes its shard under a name of its own, so an
    attempt that is lost or repeated leaves a file that no manifest names.
    """

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(path, spaced)
        id_bytes = 2 if tokens.n_ids <= 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        store, root = storage(folder)
        name, out = f"{shard:06d}-{uuid.uuid4().hex}", None
        sizes, names = [], []
        for batch in batches:
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}.ids")
            texts = batch.column("text")
            for a, n in parts(texts):
                ids, ends = tokens.encode(texts.slice(a, n))
                out.write(np.insert(ids, ends, end).astype(f"<u{id_bytes}").tobytes())
                sizes.append(np.diff(ends, prepend=0) + 1)
            # A copy: the column itself would keep the whole batch, texts too.
            names.append(pa.concat_arrays([batch.column("doc_id"), pa.array([], pa.int64())]))
        if out is None:
            return
        out.close()
        ends = np.cumsum(np.concatenate(sizes))
        ids = pa.chunked_array(names)
        known = ids.drop_null().to_numpy()
        with store.open_output_stream(f"{root}/{name}.idx") as index:
            index.write(index_bytes(ends, known, ids.null_count, id_bytes))
        row = [[shard], [name], [len(ends)], [int(ends[-1])]]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(row, kinds, strict=True)],
            ["shard", "name", "n_docs", "n_ids"],
        )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(small_batches(ordered).mapInArrow(write_shard, MANIFEST), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, its place among all ids, their number and crc32."""

    def read_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = storage(folder)
        for shard in (row for batch in batches for row in batch.to_pylist()):
            with store.open_input_stream(f"{root}/{shard['name']}.idx") as index:
                coded, above, id_bytes, base, nulls = read_index(index.read())
            ends = coded.values().astype(np.int64)
            known = (above.values() + np.uint64(base % (1 << 64))).view(np.int64)
            doc_ids = pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(known)])
            starts = np.concatenate([[0], ends[:-1]])
            with store.open_input_file(f"{root}/{shard['name']}.ids") as ids:
                first = 0
                while first < len(ends):
                    last = max(first + 1, int(np.searchsorted(ends, starts[first] + READ, "right")))
                    raw = ids.read_at(
                        int(ends[last - 1] - starts[first]) * id_bytes, int(starts[first]) * id_bytes
                    )
                    wide = memoryview(np.frombuffer(raw, f"<u{id_bytes}").astype("<u4").tobytes())
                    own = slice(first, last)
                    at = 4 * (starts[own] - starts[first])
                    to = 4 * (ends[own] - starts[first])
                    sums = [zlib.crc32(wide[a:b]) for a, b in zip(at.tolist(), to.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            doc_ids.slice(first, last - first),
                            pa.array(starts[own] + shard["base"]),
                            pa.array(ends[own] - starts[own]),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    first = last

    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)))
    return based.repartition("name").mapInArrow(read_shard, ROWS)
