"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

N-grams of the lower-cased text, within one line, are hashed; a feature is whether a text has it.
The model is fitted on a bounded sample of labelled rows (`PER_CLASS` of each label, chosen by a
hash of the id). Two distributed passes read them: one counts the texts of each label by n-gram,
and n-grams frequent enough, with a log-count ratio far enough from zero, are selected; the other
gives each sample text's selected n-grams, on which a logistic regression is fitted. Every
document's whole text is then scored by the sum of the weights of the n-grams it has.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from requestsieve.llm.common import small_batches, written

# Labelled rows of each label that the model is fitted on.
PER_CLASS = 3000
ORDERS = (4, 5, 6)
BUCKET_BITS = 20
LEAST_TEXTS = 5
LEAST_RATIO = 2.0
MOST_FEATURES = 20_000
THRESHOLD = 0.7
# Texts longer than this are hashed in overlapping stretches, for bounded memory.
STRETCH = 1_000_000
NEW_LINE = 10


def held_out(doc_id: str = "doc_id") -> Column:
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % 3 == 1


def ngram_buckets(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the n-gram of each order at each byte; those across a line end are left out."""
    if not len(raw):
        return
    value = np.zeros(len(raw), dtype=np.uint64)
    broken = raw == NEW_LINE
    within = ~broken
    for n in range(1, max(ORDERS) + 1):
        length = len(raw) - n + 1
        if length <= 0:
            return
        value = value[:length] * np.uint64(257) + raw[n - 1 :]
        within = within[:length] & ~broken[n - 1 :]
        if n in ORDERS:
            mixed = (value + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(64 - BUCKET_BITS))[within].astype(np.int64)


def stretches(text: str | None) -> Iterator[np.ndarray]:
    """The lower-cased text's bytes, with the space at its start and end that words have."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode(), dtype=np.uint8)
    for a in range(0, len(raw), STRETCH):
        yield raw[a : a + STRETCH + max(ORDERS) - 1]


def features(text: str | None, wanted: np.ndarray) -> np.ndarray:
    """Buckets of a text for which `wanted` is true, each once, in order."""
    found = [b[wanted[b]] for raw in stretches(text) for b in ngram_buckets(raw)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.zeros(1 << BUCKET_BITS, dtype=np.float32)
        table[self.buckets] = self.weights
        return table


def sample(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, toxic) of at most `per_class` labelled training rows of each label.

    Rows held out and rows without id or label are left out; an id labelled twice is used only
    if its labels agree.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .filter("toxic = most")
        .drop("most")
    )
    order = F.xxhash64("doc_id")
    some = [
        known.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(per_class)
        for label in (0, 1)
    ]
    return written(some[0].union(some[1]), "sample")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The model; without texts of both labels it gives every text the share of toxic ones.

    The sample has at most twice `per_class` rows, so it is broadcast and texts are not shuffled.
    The driver gets counts of selected n-grams and the sample's selected n-grams only.
    """
    chosen = sample(labels, per_class)
    sizes = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    none = np.zeros(0, dtype=np.int64)
    if not n0 or not n1:
        share = (n1 + 0.5) / (n0 + n1 + 10)
        return Model(none, none.astype(float), float(np.log(share / (1 - share))))
    texts = small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
        everything = np.ones(1 << BUCKET_BITS, dtype=bool)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen[toxic, features(text, everything)] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"bucket": some, "clean": seen[0, some], "toxic": seen[1, some]})

    # Smoothing keeps the labels' proportion, so an n-gram never seen has ratio zero.
    smooth = [F.lit(2.0 * n / (n0 + n1)) for n in (n0, n1)]
    ratio = F.log(
        (F.col("toxic") + smooth[1]) / n1 / ((F.col("clean") + smooth[0]) / n0)
    )
    counted = (
        texts.mapInPandas(count, "bucket bigint, clean bigint, toxic bigint")
        .groupBy("bucket")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("clean") + F.col("toxic") >= LEAST_TEXTS)
        .withColumn("ratio", ratio)
        .filter(F.abs("ratio") >= LEAST_RATIO)
        .withColumn("strength", F.abs("ratio") * F.sqrt(F.col("clean") + F.col("toxic")))
        .orderBy(F.desc("strength"), "bucket")
        .limit(MOST_FEATURES)
        .select("bucket", "ratio")
        .toPandas()
    )
    counted = counted.sort_values("bucket")
    buckets, ratios = counted["bucket"].to_numpy(np.int64), counted["ratio"].to_numpy(float)
    wanted = np.zeros(1 << BUCKET_BITS, dtype=bool)
    wanted[buckets] = True
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            yield pd.DataFrame(
                {"toxic": batch["toxic"], "buckets": [features(t, mine) for t in batch["text"]]}
            )

    rows = texts.mapInPandas(select, "toxic int, buckets array<bigint>").toPandas()
    weights, bias = logistic(
        [np.searchsorted(buckets, b) for b in rows["buckets"]],
        rows["toxic"].to_numpy(float),
        ratios,
    )
    return Model(buckets, weights, bias)


def logistic(
    rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, steps: int = 300, decay: float = 3e-3
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on presence scaled by `ratios`.

    Full-batch gradient descent with step sizes by feature; labels weigh alike in sum. Returned
    weights include the scaling.
    """
    sizes = np.array([len(r) for r in rows])
    doc = np.repeat(np.arange(len(rows)), sizes)
    col = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, dtype=np.int64)
    x = ratios[col]
    weigh = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(len(ratios)), 0.0
    seen_w, seen_b = np.full(len(ratios), 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(doc, weights=w[col] * x, minlength=len(rows)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weigh
        grad = np.bincount(col, weights=error[doc] * x, minlength=len(ratios)) + decay * w / 100
        seen_w += grad * grad
        seen_b += error.sum() ** 2
        w -= 0.05 * grad / np.sqrt(seen_w)
        b -= 0.05 * error.sum() / np.sqrt(seen_b)
    return w * ratios, float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts score the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value.table()
        wanted = table != 0
        for batch in texts:
            z = [shared.value.bias + float(table[features(t, wanted)].sum()) for t in batch]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))), dtype="float64")

    scored = docs.select("doc_id", held_out().alias("held_out"), probability("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Fit on the labels and score every document."""
    return score(docs, fit(docs, labels, per_class))
