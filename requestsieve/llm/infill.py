"""Fill-in-middle transformation by displacement scatter.

The texts of a batch are one array of bytes. A scan finds where units end and where each text is
cut; cuts and markers say by how much each segment moves. A difference array over the input
holds the change of displacement at each segment's first byte, so its cumulative sum is every
byte's shift, and one scatter builds all outputs; markers fill what is left. The inverse reads
the segments' lengths off the markers, builds the same sums and gathers the texts back.

A unit is a word with the white space before it, or white space at the end of the text.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from requestsieve.llm.common import small_batches
from requestsieve.llm.tokens import parts

SEED = 42
FIM_PERCENT = 50  # of texts that are transformed
SPM_PERCENT = 80  # of those, with the suffix first
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3  # bytes of each marker
FORMS = pa.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = range(3)
# Segments of a text in the order of the output; markers stand before each.
ORDERS = {PSM: ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), SPM: ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
RESULT = (
    StructType()
    .add("n", "long")
    .add("form", "string")
    .add("prefix_chars", "long")
    .add("middle_chars", "long")
    .add("output", "string")
)

COLUMNS = [(f.name, pa.string() if f.name in ("form", "output") else pa.int64()) for f in RESULT]


def draws(doc_ids: pa.Array, seed: int = SEED) -> np.ndarray:
    """Four numbers below 2**32 for each id; a null id counts as an empty one."""
    ids = ("" if i is None else str(i) for i in doc_ids.to_pylist())
    raw = b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, dtype=">u4").reshape(-1, 4).astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of texts that are not null, and where each text starts and the last ends."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _texts(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), buffers).cast(pa.string())


def unit_ends(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units end, text after text, and how many end before each text and in all."""
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    last = np.zeros(len(raw) + 1, dtype=bool)
    last[offsets[1:]] = True  # before these, a text ends
    after = np.append(white[1:], True) | last[1:]
    ends = np.flatnonzero((~white & after) | (white & last[1:])) + 1
    return ends, np.searchsorted(ends, offsets, "right")


def segments(cuts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where segments start in the input (rows: texts, columns: prefix, middle, suffix), by how
    much each moves, and the size of each output. `cuts` has the four edges of each text."""
    length = np.diff(cuts, axis=1)
    sizes = length.sum(axis=1) + np.where(form == PLAIN, 0, 3 * MARK)
    begins = np.cumsum(sizes) - sizes
    to = np.empty_like(length)
    plain = form == PLAIN
    to[plain] = cuts[plain, :3] - cuts[plain, :1]
    for kind, order in ORDERS.items():
        own, at = form == kind, 0
        for _, segment in order:
            at = at + MARK
            to[own, segment] = at if np.isscalar(at) else at[own]
            at = at + length[:, segment]
    return cuts[:, :3], to + begins[:, None] - cuts[:, :3], sizes


def shifts(starts: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
    """Every byte's displacement: the running sum of its changes at the segments' starts."""
    starts, moves = starts.ravel(), moves.ravel()
    change = np.zeros(n + 1, dtype=np.int64)
    # Empty segments start where the next one does, so changes there add up.
    np.add.at(change, starts, np.diff(moves, prepend=0))
    return np.cumsum(change[:n])


def scatter(raw: np.ndarray, cuts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all outputs, and the size of each."""
    starts, moves, sizes = segments(cuts, form)
    out = np.empty(int(sizes.sum()), dtype=np.uint8)
    out[np.arange(len(raw)) + shifts(starts, moves, len(raw))] = raw
    for kind, order in ORDERS.items():
        own = form == kind
        for marker, segment in order:
            ahead = (starts + moves)[own, segment] - MARK
            for k, byte in enumerate(marker):
                out[ahead + k] = byte
    return out, sizes


def gather(out: np.ndarray, cuts: np.ndarray, form: np.ndarray) -> np.ndarray:
    """The bytes of all texts; `cuts` are edges in the texts as they will be."""
    starts, moves, _ = segments(cuts, form)
    n = int(cuts[-1, -1]) if len(cuts) else 0
    return out[np.arange(n) + shifts(starts, moves, n)]


def found_cuts(outputs: pa.Array, form: np.ndarray) -> np.ndarray:
    """The edges of each text's segments, read off its output's markers.

    A text that holds a marker is plain, and a marker cannot begin before its own place, as its
    first byte is nowhere else in it; so the first one found is the right one.
    """
    raw, offsets = text_bytes(outputs)
    lengths = np.zeros((len(form), 3), dtype=np.int64)
    lengths[:, 0] = np.diff(offsets)
    places = {
        m: np.flatnonzero((raw[:-2] == m[0]) & (raw[1:-1] == m[1]) & (raw[2:] == m[2]))
        for m in (PREFIX, SUFFIX, MIDDLE)
    }
    for kind, order in ORDERS.items():
        own = np.flatnonzero(form == kind)
        begin, end = offsets[:-1][own], offsets[1:][own]
        edges = [begin + MARK]
        for marker, _ in order[1:]:
            at = places[marker][np.searchsorted(places[marker], edges[-1])]
            edges.append(at + MARK)
        stops = [e - MARK for e in edges[1:]] + [end]
        for (_, segment), a, b in zip(order, edges, stops, strict=True):
            lengths[own, segment] = b - a
    flat = np.concatenate([[0], np.cumsum(lengths.ravel())])
    return np.stack([flat[k : k + 3 * len(form) : 3] for k in range(4)], axis=1)


def _transformed(doc_ids: pa.Array, texts: pa.Array, fim: int, spm: int, seed: int) -> pa.StructArray:
    raw, offsets = text_bytes(texts)
    h = draws(doc_ids, seed)
    ends, before = unit_ends(raw, offsets)
    n = np.diff(before)
    places = h[:, :2] % (n + 1)[:, None]
    marked = np.zeros(len(texts), dtype=bool)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, marker.decode()).to_numpy(zero_copy_only=False)
    form = np.where(h[:, 3] % 100 < spm, SPM, PSM)
    form[(n == 0) | marked | (h[:, 2] % 100 >= fim)] = PLAIN
    # The edge after k units of a text; after none, its start.
    edges = np.append(0, ends)
    at = lambda k: np.where(k == 0, offsets[:-1], edges[before[:-1] + k])
    cuts = np.stack([offsets[:-1], at(places.min(axis=1)), at(places.max(axis=1)), offsets[1:]], axis=1)
    out, sizes = scatter(raw, cuts, form)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[cuts]
    plain = form == PLAIN
    count = lambda a, b: pa.array(chars[:, b] - chars[:, a], pa.int64(), mask=plain)
    columns = [
        pa.array(n, pa.int64()), FORMS.take(pa.array(form)), count(0, 1), count(1, 2), _texts(out, sizes)
    ]
    return pa.StructArray.from_arrays(columns, fields=[pa.field(*c) for c in COLUMNS])


def transform(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """`docs` with n (units), form, prefix_chars, middle_chars and output of each whole text.

    Null texts are empty; empty texts and texts that hold a marker stay plain, with null counts.
    Draws depend on the id alone, so repeated rows are equal; a null id counts as empty text.
    Other columns stay; those called as the new ones are replaced. No rows give none. A text is
    worked on whole in one task, with memory of about fifty times its size.
    """

    @F.arrow_udf(RESULT)
    def transformed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for doc_ids, texts in batches:
            found = [pa.array([], pa.struct(COLUMNS))] + [
                _transformed(doc_ids.slice(a, n), texts.slice(a, n), fim_percent, spm_percent, seed)
                for a, n in parts(texts)
            ]
            yield pa.concat_arrays(found)

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = small_batches(docs).withColumn("__rs_fim", transformed(F.col(doc_id).cast("long"), whole))
    return rows.withColumns({c: F.col(f"__rs_fim.{c}") for c in RESULT.fieldNames()}).drop("__rs_fim")


def restore(rows: DataFrame, output: str = "output", form: str = "form", text: str = "restored") -> DataFrame:
    """`rows` with the text that each output was made of; null outputs count as plain and empty."""

    @F.arrow_udf(StringType())
    def restored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            found = [pa.array([], pa.string())]
            for a, n in parts(outputs):
                own = outputs.slice(a, n)
                kind = pc.index_in(forms.slice(a, n), value_set=FORMS).to_numpy()
                cuts = found_cuts(own, kind)
                found.append(_texts(gather(text_bytes(own)[0], cuts, kind), cuts[:, 3] - cuts[:, 0]))
            yield pa.concat_arrays(found)

    inputs = F.coalesce(F.col(output), F.lit("")), F.coalesce(F.col(form), F.lit("plain"))
    return small_batches(rows).withColumn(text, restored(*inputs))
