"""Per-minute activity of each client: the small table that rates and sessions come from.

Everything stateful is derived from one row per (ip, minute), which partial aggregation
produces on the map side. However many requests a client sends, it has at most one such row
per minute, so the per-client window in `sessions` stays small. Rows themselves are shuffled
once, by (ip, minute), to be ranked. Minutes of one client that hold more than
`Settings.hot_rows` requests are ranked in blocks: their rows are range-partitioned by client,
time and request id, into enough parts that none is above that size, however times and ids
lie, and the counted sizes of the parts give each its starting rank.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from requestsieve.functions.signals import MINUTE_MS, minute_bucket
from requestsieve.session import durable
from requestsieve.settings import DEFAULTS, Settings

MINUTE_KEY = ["ip", "minute"]
BLOCK_KEY = [*MINUTE_KEY, "block_id"]
# Parts are planned at this share of the allowed size, as their edges come from a sample.
PLANNED_SHARE = 0.4


def split_trackable(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that have a client and a time, and the rest, which no window or session holds."""
    known = F.col("ip").isNotNull() & F.col("ts_ms").isNotNull()
    return requests.filter(known), requests.filter(~known)


def window_counts(requests: DataFrame) -> DataFrame:
    """Requests per (ip, minute)."""
    return requests.groupBy("ip", minute_bucket(F.col("ts_ms")).alias("minute")).agg(
        F.count(F.lit(1)).alias("n")
    )


def lookup_counts(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The count of each wanted (ip, minute); 0 where nothing was seen."""
    return wanted.join(counts, MINUTE_KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def live_windows(requests: DataFrame, now_ms: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Windows whose two minutes, counted from their first request, are not over at `now_ms`."""
    return (
        minute_activity(requests.filter(F.col("ts_ms") <= now_ms))
        .withColumn("expiry_ms", F.col("first_ms") + settings.rate_window_ttl_ms)
        .filter(F.col("expiry_ms") >= now_ms)
        .select("ip", "minute", "n", "expiry_ms")
    )


def minute_activity(requests: DataFrame) -> DataFrame:
    return requests.groupBy("ip", minute_bucket(F.col("ts_ms")).alias("minute")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
    )


@dataclass(frozen=True)
class Ranking:
    """How rows are spread for ranking, and the starting rank of each block."""

    requests: DataFrame
    keys: list[str]
    block_starts: DataFrame | None


def _broadcast_if_small(keys: DataFrame, settings: Settings) -> DataFrame:
    """A hint only if the (already materialised) list is small; else Spark chooses the join."""
    size = keys.limit(settings.broadcast_keys + 1).count()
    return F.broadcast(keys) if size <= settings.broadcast_keys else keys


def spread_for_ranking(
    requests: DataFrame, minutes: DataFrame, settings: Settings = DEFAULTS
) -> Ranking:
    """Leave ordinary minutes whole; cut hot ones into ordered blocks.

    `minutes` has `n` per (ip, minute), of the hot ones at least, and must be materialised: it
    is asked for its hot rows first. Rows of hot minutes are kept on reliable storage with
    their block. Only rows that are equal in all columns cannot be divided.
    """
    requests = requests.withColumn("minute", minute_bucket(F.col("ts_ms")))
    hot_minutes = minutes.filter(F.col("n") > settings.hot_rows).select(*MINUTE_KEY, "n")
    hot_total = hot_minutes.agg(F.sum("n")).first()[0]
    if hot_total is None:
        return Ranking(requests, MINUTE_KEY, None)

    marked = requests.join(
        _broadcast_if_small(hot_minutes.select(*MINUTE_KEY, F.lit(True).alias("is_hot")), settings),
        MINUTE_KEY,
        "left",
    )
    blocks = 1 + int(hot_total / (PLANNED_SHARE * settings.hot_rows))
    hashed = [f.name for f in requests.schema.fields if not isinstance(f.dataType, T.MapType)]
    hot = durable(
        marked.filter("is_hot")
        .select(*requests.columns, F.xxhash64(*hashed).alias("_tie"))
        .repartitionByRange(blocks, *MINUTE_KEY, "ts_ms", "request_id", "_tie")
        .select(*requests.columns, F.spark_partition_id().cast("long").alias("block_id"))
    )
    ordinary = marked.filter("is_hot IS NULL").select(
        *requests.columns, F.lit(-1).cast("long").alias("block_id")
    )
    earlier = (
        Window.partitionBy(*MINUTE_KEY)
        .orderBy("block_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    block_starts = (
        hot.groupBy(*BLOCK_KEY)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("rank_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .drop("n")
    )
    return Ranking(ordinary.unionByName(hot), BLOCK_KEY, block_starts)


def rank_rows(ranking: Ranking, slots: DataFrame | None = None) -> DataFrame:
    """Add `rate`, the ordinal of each request in its (ip, minute), and the slot columns.

    `slots` holds one row per (ip, minute). Its columns arrive by the join that also brings
    the starting ranks, on the partitioning that ranking needs anyway. The ranking keys stay,
    for `join_slots`; `drop_blocks` removes those that are not the caller's.
    """
    order = Window.partitionBy(*ranking.keys).orderBy("ts_ms", "request_id")
    ranked = ranking.requests.withColumn("_rank", F.row_number().over(order).cast("long"))
    if ranking.block_starts is None:
        rows = ranked if slots is None else ranked.join(slots, MINUTE_KEY)
        return rows.withColumnRenamed("_rank", "rate")

    if slots is None:
        rows = ranked.join(ranking.block_starts, BLOCK_KEY, "left")
    else:
        rows = ranked.join(_block_slots(ranking, slots), BLOCK_KEY)
    return rows.withColumn(
        "rate", F.coalesce("rank_before", F.lit(0)) + F.col("_rank")
    ).drop("_rank", "rank_before")


def _block_slots(ranking: Ranking, slots: DataFrame) -> DataFrame:
    """The slots at the grain rows are spread at: one per block of a hot minute."""
    return slots.join(ranking.block_starts, MINUTE_KEY, "left").fillna(
        {"block_id": -1, "rank_before": 0}
    )


def join_slots(ranked: DataFrame, ranking: Ranking, slots: DataFrame) -> DataFrame:
    """Join one row per (ip, minute) to ranked rows, on the keys they are partitioned by."""
    if ranking.block_starts is None:
        return ranked.join(slots, MINUTE_KEY)
    return ranked.join(_block_slots(ranking, slots).drop("rank_before"), BLOCK_KEY)


def drop_blocks(ranked: DataFrame) -> DataFrame:
    return ranked.drop("block_id")


def request_rate(requests: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add `minute` and `rate`, the 1-based ordinal of each request in its (ip, minute)."""
    # Only the hot minutes are kept; they are all that ranking needs to know beforehand.
    hot = durable(window_counts(requests).filter(F.col("n") > settings.hot_rows))
    return drop_blocks(rank_rows(spread_for_ranking(requests, hot, settings)))
