"""Substring deduplication by compaction of a de Bruijn graph of words.

Edges are windows of 50 words. A run of windows of one document that share their least inner
k-mer (the anchor) is one path of the graph, stored by anchor and by the content of all its
words: equal windows always share their anchor, and paths of equal content are one compacted
path. Where an anchor has one content only, its path does not branch, and the first document
with that content decides for all its windows at once. Where contents differ, only the first
document of each is taken apart into windows, which are compared one by one. The found spans
go back to the documents by their source coordinates, where the texts are read again.

Contents and windows are compared by 128-bit digests of their words.
"""

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requestsieve.llm.common import ROW_KEY, row_key, small_batches, written

WINDOW = 50
ANCHOR = 25
LAST_ID = 2**63 - 1
PATHS = (
    "__rs_id bigint, __rs_row bigint, anchor bigint, content binary, first int, windows int"
)


class WordHashes(dict):
    """64-bit hashes of words; emptied when it is full."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


KNOWN = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def anchors(words: list[bytes], window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the text, the place and hash of its least k-mer, the last one if tied.

    A k-mer's hash is that of its words' hashes at their places in it, so a window's choice
    depends on its own words only.
    """
    own = np.fromiter(map(KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))
    # Sums over a k-mer by doubling: block[i] covers 2^j words from i.
    block, width, total, at = own, 1, None, 0
    left = k
    while left:
        if left & 1:
            part = block[at : at + len(words) - k + 1]
            total = part if total is None else _mix(total) + part
            at += width
        left >>= 1
        if left:
            block = _mix(block[: len(block) - width]) + block[width:]
            width *= 2
    hashes = _mix(total)
    span = window - k + 1
    n = len(words) - window + 1
    least = hashes[:n].copy()
    place = np.arange(n)
    for j in range(1, span):
        later = hashes[j : j + n]
        better = later <= least
        least = np.where(better, later, least)
        place[better] = np.arange(j, j + n)[better]
    return place, least.view(np.int64)


def paths_of(text: str, window: int, k: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(anchor, content, first window, windows) of each run of windows with one anchor."""
    words = text.encode().split()
    if len(words) < window:
        return
    place, least = anchors(words, window, k)
    edges = np.flatnonzero(np.diff(place, prepend=-1))
    stops = np.append(edges[1:], len(place))
    values = least[edges]
    for a, b, anchor in zip(edges.tolist(), stops.tolist(), values.tolist(), strict=True):
        yield anchor, md5(b" ".join(words[a : b - 1 + window])).digest(), a, b - a


def graph_paths(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """The paths of every text, with the row they come from; texts below a window have none."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["__rs_id", "__rs_row", "anchor", "content", "first", "windows"]
        for batch in batches:
            rows = []
            for doc, row, text in zip(batch["__rs_id"], batch["__rs_row"], batch["text"], strict=True):
                rows += [(doc, row, *p) for p in paths_of(text, window, k)]
                if len(rows) > 100_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return docs.mapInPandas(walk, PATHS)


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """Digests of the windows of the chosen paths (`runs`) of each text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["__rs_id", "__rs_row", "at", "content"]
        for batch in batches:
            out = []
            for doc, row, text, runs in zip(
                batch["__rs_id"], batch["__rs_row"], batch["text"], batch["runs"], strict=True
            ):
                words = text.encode().split()
                for run in runs:
                    for i in range(run["first"], run["first"] + run["windows"]):
                        out.append((doc, row, i, md5(b" ".join(words[i : i + window])).digest()))
                if len(out) > 100_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(cut, "__rs_id bigint, __rs_row bigint, at int, content binary")


def _with_runs(texts: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Texts with their spans (first, windows) in one array; a text has no more than its words."""
    runs = spans.groupBy(*ROW_KEY).agg(
        F.collect_list(F.struct("first", "windows")).alias("runs")
    )
    return texts.join(runs, ROW_KEY, how)


def repeated_spans(texts: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """(row key, first, windows): runs of windows that also start in a document of smaller id.

    Groups by content and by anchor are reduced within each task first, so a passage that very
    many documents hold is a few rows after the shuffle.
    """
    paths = written(graph_paths(texts, window, k), "paths")
    first = F.min("__rs_id").alias("first_id")
    contents = written(
        paths.groupBy("anchor", "content").agg(first, F.count(F.lit(1)).alias("copies")), "contents"
    )
    branching = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1")
    # Only contents that occur again or share their anchor can matter.
    shared = written(
        contents.join(branching, "anchor", "left")
        .filter("copies > 1 or contents > 1")
        .withColumn("branches", F.col("contents").isNotNull())
        .select("content", "first_id", "branches"),
        "shared",
    )
    known = written(paths.drop("anchor").join(shared, "content"), "known")
    whole = known.filter("__rs_id > first_id").select(*ROW_KEY, "first", "windows")
    apart = known.filter("branches and __rs_id = first_id").select(*ROW_KEY, "first", "windows")
    windows = written(_windows(_with_runs(texts, apart, "inner"), window), "windows")
    firsts = (
        windows.groupBy("content")
        .agg(first, F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    single = (
        windows.join(firsts, "content")
        .filter("__rs_id > first_id")
        .select(*ROW_KEY, F.col("at").alias("first"), F.lit(1).alias("windows"))
    )
    return whole.union(single)


def _kept(text: str, runs, window: int) -> tuple[int, int, str]:
    words = text.encode().split()
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for run in runs if runs is not None else ():
        edges[run["first"]] += 1
        edges[run["first"] + run["windows"] - 1 + window] -= 1
    keep = np.cumsum(edges[:-1]) == 0
    rest = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    return len(words), len(words) - len(rest), b" ".join(rest).decode()


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the kept words joined by one space.

    Every window of the input that also starts in a document with a smaller doc_id goes, judged
    on the input. Null and empty texts have no words. Rows with the same doc_id do not
    take from each other; a null doc_id comes after all others. No rows give none.
    """
    keys = row_key()
    texts = small_batches(docs).select(
        "doc_id",
        F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("__rs_id"),
        keys[1],
        F.coalesce("text", F.lit("")).alias("text"),
    )
    spans = repeated_spans(texts.select(*ROW_KEY, "text"), window, k)

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_kept(t, r, window) for t, r in zip(batch["text"], batch["runs"], strict=True)]
            out = pd.DataFrame(found, columns=["n_words", "n_removed", "kept"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    joined = _with_runs(texts, spans, "left").select("doc_id", "text", "runs")
    return joined.mapInPandas(
        strip, "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    )
