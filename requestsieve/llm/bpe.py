"""BPE encoding by a segment tree over adjacent pair ranks, and decoding.

The symbols of a pre-token are the leaves: a leaf holds the rank of its symbol's pair with the
next symbol, then its position, so the root is the leftmost pair of lowest rank. A merge changes
three leaves (the merged symbol, the one it swallowed and the one before), each in logarithmic
time; merging ends when the root holds no pair. The trees of many short pre-tokens are rows of
one array and merge side by side; a long pre-token has a tree of its own.

Cutting texts into pre-tokens and keeping ids of plain words between batches is in `tokens`.
"""

import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType
from tokenizers import Tokenizer

from requestsieve.llm.common import small_batches
from requestsieve.llm.tokens import WordTokenizer, byte_letters, parts

NONE = np.int64(1) << 62  # a leaf without a pair that may merge
SHORT = 64  # symbols; pre-tokens up to this length merge side by side
AT_ONCE = 1 << 20  # leaves of trees that merge side by side


class Merges:
    """Merge rules: the rank of a pair of ids, and the id that each rank's pair becomes."""

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int]):
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.merged = np.array(merged, dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; `NONE` where there is no rule (as for a negative id)."""
        if not len(self.keys):
            return np.full(left.shape, NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.order[at], NONE)

    @cached_property
    def rank_of(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.order.tolist(), strict=True))


def merge_rows(symbols: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids left in each row of `symbols`, row after row, and their number in each.

    Rows are a power of two wide and filled up with -1.
    """
    n, width = symbols.shape
    ids = np.full((n, width + 1), -1, dtype=np.int64)  # the last column stands for no symbol
    ids[:, :width] = symbols
    after = np.tile(np.arange(1, width + 2), (n, 1)).ravel()
    before = np.tile(np.arange(-1, width), (n, 1))
    before[:, 0] = width
    before = before.ravel()
    tree = np.full((n, 2 * width), NONE)
    ranks = merges.rank(ids[:, : width - 1], ids[:, 1:width])
    tree[:, width:-1] = np.where(ranks < NONE, ranks * width + np.arange(width - 1), NONE)
    level = width // 2
    while level:
        below = tree[:, 2 * level : 4 * level]
        tree[:, level : 2 * level] = np.minimum(below[:, ::2], below[:, 1::2])
        level //= 2
    tree, ids = tree.ravel(), ids.ravel()
    rows = np.arange(n)
    while True:
        top = tree[rows * 2 * width + 1]
        live = top < NONE
        rows, top = rows[live], top[live]
        if not len(rows):
            break
        at, own = rows * (width + 1), rows * 2 * width
        rank, i = np.divmod(top, width)
        j = after[at + i]
        k, p = after[at + j], before[at + i]
        new = merges.merged[rank]
        ids[at + i], ids[at + j] = new, -1
        after[at + i], before[at + k] = k, i
        to_right = merges.rank(new, ids[at + k])
        to_left = merges.rank(ids[at + p], new)
        alone = p == width
        p = np.where(alone, i, p)
        to_left = np.where(alone, to_right, to_left)
        tree[own + width + j] = NONE
        tree[own + width + i] = np.where(to_right < NONE, to_right * width + i, NONE)
        tree[own + width + p] = np.where(to_left < NONE, to_left * width + p, NONE)
        nodes = np.stack([i, j, p]) + width
        for _ in range(width.bit_length() - 1):
            nodes >>= 1
            below = own + 2 * nodes
            tree[own + nodes] = np.minimum(tree[below], tree[below + 1])
    left = ids.reshape(n, width + 1)[:, :width]
    stays = left >= 0
    return left[stays].astype(np.uint32), stays.sum(axis=1)


def merge_one(symbols: list[int], merges: Merges) -> list[int]:
    """Ids left of one pre-token of any length."""
    n = len(symbols)
    width = 1 << max(n - 1, 1).bit_length()
    none, rank_of, merged = int(NONE), merges.rank_of, merges.merged
    ids = [*symbols, -1]  # the last place stands for no symbol
    after, before = list(range(1, n + 1)), [n, *range(n)]

    def key(i: int) -> int:
        right = ids[after[i]]
        rank = rank_of.get(ids[i] << 32 | right) if right >= 0 else None
        return none if rank is None else rank * width + i

    tree = [none] * width + [key(i) for i in range(n)] + [none] * (width - n)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] < none:
        rank, i = divmod(tree[1], width)
        j = after[i]
        ids[i], ids[j] = int(merged[rank]), -1
        after[i] = k = after[j]
        before[k] = i
        tree[width + j] = none
        changed = [i, j] if before[i] == n else [i, j, before[i]]
        for leaf in changed:
            if leaf != j:
                tree[width + leaf] = key(leaf)
            node = (width + leaf) >> 1
            while node:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
                node >>= 1
    return [i for i in ids if i >= 0]


def merge_all(
    symbols: np.ndarray, sizes: np.ndarray, merges: Merges
) -> tuple[np.ndarray, np.ndarray]:
    """As `merge_rows`, of pre-tokens whose symbols follow one another."""
    starts = np.cumsum(sizes) - sizes
    found, counts = [], np.zeros(len(sizes), dtype=np.int64)
    which = []
    low = 0
    for width in (1 << k for k in range(1, SHORT.bit_length())):
        own = np.flatnonzero((sizes > low) & (sizes <= width))
        low = width
        for a in range(0, len(own), max(1, AT_ONCE // width)):
            rows = own[a : a + max(1, AT_ONCE // width)]
            place = np.arange(width)
            inside = place < sizes[rows, None]
            table = np.full((len(rows), width), -1, dtype=np.int64)
            table[inside] = symbols[(starts[rows, None] + place)[inside]]
            ids, counts[rows] = merge_rows(table, merges)
            found.append(ids)
            which.append(rows)
    for row in np.flatnonzero(sizes > SHORT).tolist():
        ids = merge_one(symbols[starts[row] : starts[row] + sizes[row]].tolist(), merges)
        found.append(np.array(ids, dtype=np.uint32))
        counts[row] = len(ids)
        which.append(np.array([row]))
    if not found:
        return np.zeros(0, np.uint32), counts
    # From the order in which they merged to that of the pre-tokens.
    flat, which = np.concatenate(found), np.concatenate(which)
    done = counts[which]
    to = (np.cumsum(counts) - counts)[which]
    out = np.empty(len(flat), dtype=np.uint32)
    out[np.arange(len(flat)) + np.repeat(to - (np.cumsum(done) - done), done)] = flat
    return out, counts


class Encoder(WordTokenizer):
    """Encodes as the library does; its merges are those of the segment tree.

    The file is byte-level BPE; added tokens match wherever their text stands.
    """

    def __init__(self, path: str):
        super().__init__(path, spaced=True)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        rules = _rules(path)
        self.merges = Merges(
            [(vocabulary[a], vocabulary[b]) for a, b in rules], [vocabulary[a + b] for a, b in rules]
        )
        self.first = np.full(1 + max(map(ord, self.letters.values())), -1, dtype=np.int64)
        for letter in self.letters.values():
            self.first[ord(letter)] = vocabulary[letter]
        self.added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")" if longest else "(?!)()")

    def _model(self, mapped: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters = np.frombuffer("".join(mapped).encode("utf-32-le"), dtype="<u4")
        sizes = np.fromiter(map(len, mapped), dtype=np.int64, count=len(mapped))
        ids, counts = merge_all(self.first[letters], sizes, self.merges)
        return ids, counts.astype(np.int32)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library cuts texts into pre-tokens; added tokens are cut out before."""
        cut = self.library.pre_tokenizer.pre_tokenize_str
        mapped, ends, special = [], [], []
        for text in texts:
            for part in self.cut.split(text):
                if part in self.added:
                    special.append((len(mapped), self.added[part]))
                    mapped.append("")
                elif part:
                    mapped += [t for t, _ in cut(part)]
            ends.append(len(mapped))
        ids, counts = self._model(mapped)
        if special:
            which, own = np.array(special).T
            ids = np.insert(ids, (np.cumsum(counts) - counts)[which], own.astype(np.uint32))
            counts[which] = 1
        sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[[0, *ends]]
        return ids, np.diff(sums).astype(np.int32)


def _rules(path: str) -> list[tuple[str, str]]:
    with open(path, encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]


class Decoder:
    """Joins the bytes of ids; bytes that are not UTF-8 become replacement characters."""

    def __init__(self, path: str):
        library = Tokenizer.from_file(path)
        letters = {c: b for b, c in byte_letters().items()}
        table = {i: t for t, i in library.get_vocab(with_added_tokens=True).items()}
        own = [table.get(i, "") for i in range(1 + max(table, default=-1))]
        self.bytes = pa.array(
            [bytes(map(letters.get, t)) if all(c in letters for c in t) else t.encode() for t in own],
            pa.large_binary(),
        )

    def decode(self, ids: pa.Array, ends: np.ndarray) -> list[str]:
        """Texts of runs of ids that end at `ends`; ids without a token give nothing."""
        ids = ids.to_numpy(zero_copy_only=False)
        known = (ids >= 0) & (ids < len(self.bytes))
        joined = self.bytes.take(pa.array(np.where(known, ids, 0), mask=~known)).fill_null(b"")
        stops = np.frombuffer(joined.buffers()[1], dtype=np.int64)[: len(ids) + 1]
        stops = stops[np.concatenate([[0], ends])].tolist() if len(ids) else [0] * (len(ends) + 1)
        raw = memoryview(joined.buffers()[2] or b"")
        return [str(raw[a:b], "utf-8", "replace") for a, b in zip(stops, stops[1:], strict=False)]


WORKER: dict[tuple[type, str], object] = {}


def _of_worker(kind: type, path: str):
    """One for each Python worker, which serves many tasks."""
    if (kind, path) not in WORKER:
        pa.set_memory_pool(pa.system_memory_pool())
        WORKER[kind, path] = kind(path)
    return WORKER[kind, path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the token ids of each whole text, a list of integers.

    Null texts are empty; empty texts have no ids. Every row keeps its other columns, repeated
    rows too; a column called as `ids` is replaced. No rows give none.
    """

    @F.arrow_udf(ArrayType(IntegerType()))
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _of_worker(Encoder, path)
        for texts in batches:
            flat, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int32)]
            for a, n in parts(texts):
                found, ends = encoder.encode(texts.slice(a, n))
                flat.append(found.view(np.int32))
                sizes.append(np.diff(ends, prepend=0).astype(np.int32))
            offsets = np.cumsum(np.concatenate(sizes), dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))

    return small_batches(docs).withColumn(ids, encoded(F.coalesce(F.col(text), F.lit(""))))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`rows` with the text of each list of ids; null lists and empty ones give empty texts."""

    @F.arrow_udf(StringType())
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _of_worker(Decoder, path)
        for lists in batches:
            offsets = np.asarray(lists.offsets)
            own = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            yield pa.array(decoder.decode(own, offsets[1:] - offsets[0]), pa.string())

    whole = F.coalesce(F.col(ids), F.array().cast("array<int>"))
    return small_batches(rows).withColumn(text, decoded(whole))
