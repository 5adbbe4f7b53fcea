"""Shards of near-equal bytes by sampled splitters.

Records are ordered by (hash of the text, doc_id). A size-weighted sample of these keys gives
quantile boundaries of many small ranges; ranges whose measured size is far above their share
are sampled again and subdivided, so a text that holds a third of all rows is cut by doc_id.
Every range is sorted in a task of its own, exact sizes of the ranges before it place its rows
in the whole order, and each shard takes an equal stretch of bytes of that order. A shard's end is
moved to the edge of a group of equal texts, if the group is at most `GROUP_SHARE` of a shard, so
such groups lie in one shard, and shards differ by little more than that share; larger groups are
cut between records.
"""

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from requestsieve.llm.common import lookup, running, whole_text, written

LAW = "bytes"
ROUNDS = 8
# Of a shard's bytes; larger groups of equal texts may be cut.
GROUP_SHARE = 0.02


def records(docs: DataFrame, overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, key); size is UTF-8 bytes plus `overhead`, null text is empty."""
    text = whole_text()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__rs_key"),
        F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("long").alias("__rs_id"),
    )


def draw(rows: DataFrame, total: int, draws: int, round_no: int) -> list[tuple[int, int, float]]:
    """About `draws` keys in order, each drawn with probability by size, and their weights.

    A record larger than 1 / `draws` of the total is always drawn and weighs more instead.
    The draw follows a hash, so reruns agree. At most a few times `draws` rows are collected.
    """
    chance = F.col("size") * F.lit(draws / total)
    point = F.pmod(F.xxhash64("__rs_key", "__rs_id", F.lit(round_no)), F.lit(1 << 53))
    drawn = rows.filter(point < chance * F.lit(float(1 << 53))).select(
        "__rs_key", "__rs_id", F.greatest(F.lit(1.0), chance).alias("weight")
    )
    return sorted((r["__rs_key"], r["__rs_id"], r["weight"]) for r in drawn.collect())


def quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """Keys that cut the sample into `parts` of about equal weight."""
    sums, total = [], 0.0
    for *_, weight in sample:
        total += weight
        sums.append(total)
    cuts = [bisect_left(sums, total * k / parts) for k in range(1, parts)] if sample else []
    return sorted({sample[k][:2] for k in cuts if k < len(sample)})


def range_of(bounds: list[tuple[int, int]], width: int = 40) -> Column:
    """Number of boundaries at or below a record's key, found in two steps."""
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not blocks:
        return F.lit(0)
    pair = "struct<k:bigint,i:bigint>"

    def constant(value, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(value)), kind)

    def named(part):
        return [{"k": k, "i": i} for k, i in part]

    own = F.struct(F.col("__rs_key").alias("k"), F.col("__rs_id").alias("i"))
    tops = constant(named([b[0] for b in blocks]), f"array<{pair}>")
    inner = constant([named(b) for b in blocks], f"array<array<{pair}>>")
    block = F.size(F.filter(tops, lambda b: b <= own))
    within = F.size(F.filter(F.get(inner, block - 1), lambda b: b <= own))
    return F.when(block == 0, 0).otherwise((block - 1) * width + within)


def splitters(rows: DataFrame, total: int, ranges: int, per_range: int) -> list[tuple[int, int]]:
    """Boundaries of at least `ranges` ranges, none of them above twice its share of bytes.

    Only a single key can stay above that.
    """
    bounds = quantiles(draw(rows, total, ranges * per_range, 0), ranges)
    share = total / ranges
    for round_no in range(1, ROUNDS):
        sizes = (
            rows.groupBy(range_of(bounds).alias("range"))
            .agg(
                F.sum("size").alias("size"),
                F.max(F.struct("__rs_key", "__rs_id")).alias("last"),
                F.min(F.struct("__rs_key", "__rs_id")).alias("first"),
            )
            .filter((F.col("size") > 2 * share) & (F.col("first") != F.col("last")))
            .collect()
        )
        if not sizes:
            break
        cuts = set(bounds)
        for overfull in sizes:
            inside = rows.filter(range_of(bounds) == overfull["range"])
            parts = int(overfull["size"] / share) + 1
            cuts.update(
                quantiles(draw(inside, overfull["size"], parts * per_range, round_no), parts)
            )
        if len(cuts) == len(bounds):
            break
        bounds = sorted(cuts)
    return bounds


def assign(
    docs: DataFrame,
    shards: int = 24,
    ranges: int | None = None,
    per_range: int = 64,
    group_share: float = GROUP_SHARE,
) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard (null).

    Slots number the records of a shard from 0. Repeated rows are records of their own. A null
    doc_id sorts first. An empty table gives no rows. `ranges` defaults to sixteen for each
    shard or four for each shuffle partition, if that is more; it changes no result. Texts are
    equal if their 64-bit hashes are.
    """
    spark = docs.sparkSession
    rows = written(records(docs), "records")
    total = rows.agg(F.sum("size")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or max(16 * shards, 4 * partitions)
    bounds = splitters(rows, total, ranges, per_range) if total else []
    ordered = written(
        running(
            rows.withColumn("__rs_range", range_of(bounds)),
            [],
            "__rs_range",
            ["__rs_key", "__rs_id"],
            "size",
        ),
        "ordered",
    )
    # Groups that stay whole: their copies lie together in the order, so one middle places all.
    groups = written(
        ordered.groupBy("__rs_key")
        .agg(
            F.count(F.lit(1)).alias("__rs_copies"),
            F.sum("size").alias("__rs_group"),
            F.min("__rs_start").alias("__rs_from"),
        )
        .filter((F.col("__rs_copies") > 1) & (F.col("__rs_group") <= group_share * total / shards)),
        "groups",
    )
    grouped = lookup(
        ordered, groups, "__rs_key", "__rs_copies", ["__rs_from", "__rs_group"], F.col("__rs_id")
    )
    start = F.coalesce("__rs_from", "__rs_start")
    middle = (2 * start + F.coalesce("__rs_group", "size")) * shards
    placed = written(
        grouped.withColumn("shard", F.floor(middle / F.lit(2 * max(total, 1))).cast("int")),
        "shards",
    )
    firsts = placed.groupBy("shard").agg(F.min("__rs_rank").alias("__rs_first"))
    # At most one row per shard, so it may be broadcast.
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("__rs_rank") - F.col("__rs_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
