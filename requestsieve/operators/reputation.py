"""The reputation cache: sliding-expiry sessions per client.

Every request touches its client's cache entry, whatever stage decides it. So whether a
request hits the cache depends on times alone, and sessions can be found before any verdict.
No hour-long gap fits into a minute, so a session always starts with a minute's first request.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from requestsieve.operators.activity import (
    drop_blocks,
    minute_activity,
    rank_rows,
    split_trackable,
    spread_for_ranking,
)
from requestsieve.session import durable
from requestsieve.settings import DEFAULTS, Settings

SESSION_KEY = ["ip", "session_start"]
# A minute before any other, where what is remembered of a client stands.
REMEMBERED = -(2**62)


def session_minutes(
    minutes: DataFrame, settings: Settings = DEFAULTS, entries: DataFrame | None = None
) -> DataFrame:
    """Assign each (ip, minute) to a session.

    Adds `session_start` (time of the session's first request), `opens_session`, `hits_before`
    (requests of the session in earlier minutes), `rate_before` (requests counted in this minute
    already), `expiry_ms` (of the rate window), `seen_ms` (latest touch so far) and `carried_ms`
    (the touch that was remembered, NULL where there is none).

    `entries` are what is remembered of earlier batches, at most one for each ip: they stand
    ahead of the client's minutes, so a session and a rate window go on where they were. A
    request older than the remembered touch is late: it is a hit, as time does not turn back.
    """
    columns = ["ip", "minute", "n", "first_ms", "last_ms"]
    rows = minutes.select(*columns)
    if entries is not None:
        remembered = entries.select(
            "ip",
            F.lit(REMEMBERED).alias("minute"),
            F.col("hits").alias("n"),
            F.col("session_start").alias("first_ms"),
            F.col("last_seen").alias("last_ms"),
        )
        rows = rows.unionByName(remembered)
    by_time = Window.partitionBy("ip").orderBy("minute")
    so_far = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = by_time.rowsBetween(Window.unboundedPreceding, -1)

    previous_ms = F.max("last_ms").over(earlier)
    opens = previous_ms.isNull() | (
        F.col("first_ms") - previous_ms >= settings.reputation_ttl_ms
    )
    marked = rows.withColumns(
        {
            "opens_session": opens,
            "seen_ms": F.max("last_ms").over(so_far),
            "carried_ms": F.max(F.when(F.col("minute") == REMEMBERED, F.col("last_ms"))).over(so_far),
            "_before": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
        }
    )

    def at_opening(value):
        return F.last(F.when(F.col("opens_session"), value), ignorenulls=True).over(so_far)

    found = marked.withColumn("session_start", at_opening(F.col("first_ms"))).withColumn(
        "hits_before", F.col("_before") - at_opening(F.col("_before"))
    )
    fresh_ms = F.col("first_ms") + settings.rate_window_ttl_ms
    if entries is None:
        return found.drop("_before").withColumns(
            {"rate_before": F.lit(0).cast("long"), "expiry_ms": fresh_ms}
        )
    windows = entries.select("ip", F.inline("windows")).toDF("ip", "minute", "_n", "_expiry")
    goes_on = F.col("_expiry") >= F.col("first_ms")
    return (
        found.filter(F.col("minute") != REMEMBERED)
        .join(windows, ["ip", "minute"], "left")
        .withColumns(
            {
                "rate_before": F.when(goes_on, F.col("_n")).otherwise(0).cast("long"),
                "expiry_ms": F.when(goes_on, F.col("_expiry")).otherwise(fresh_ms),
            }
        )
        .drop("_before", "_n", "_expiry")
    )


def entries_after(
    slots: DataFrame, entries: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """What is to be remembered of the clients in `slots`: their last session and live windows.

    `verdicts` has (ip, session_start, score, class), of new sessions and of remembered ones.
    """
    value = F.struct(
        "session_start", (F.col("hits_before") + F.col("n")).alias("hits"), F.col("seen_ms").alias("last_seen")
    )
    last = slots.groupBy("ip").agg(F.max_by(value, "minute").alias("e")).select("ip", "e.*")
    counted = slots.select(
        "ip", "minute", (F.col("rate_before") + F.col("n")).alias("n"), "expiry_ms"
    )
    older = entries.select("ip", F.inline("windows")).toDF("ip", "minute", "n", "expiry_ms")
    windows = counted.unionByName(older.join(counted, ["ip", "minute"], "left_anti"))
    alive = (
        windows.join(last.select("ip", "last_seen"), "ip")
        .filter(F.col("expiry_ms") >= F.col("last_seen"))
        .groupBy("ip")
        .agg(F.sort_array(F.collect_list(F.struct("minute", "n", "expiry_ms"))).alias("windows"))
    )
    return (
        last.join(verdicts.select(*SESSION_KEY, "score", "class"), SESSION_KEY, "left")
        .join(alive, "ip", "left")
        .select("ip", "score", "class", "hits", "last_seen", "session_start", "windows")
    )


def reputation_sessions(requests: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per session: start, last touch, number of requests."""
    return sessions_of(session_minutes(minute_activity(requests), settings))


def sessions_of(slots: DataFrame) -> DataFrame:
    return slots.groupBy(*SESSION_KEY).agg(
        F.max("last_ms").alias("last_seen"), F.sum("n").alias("hits")
    )


def with_session_hits(ranked: DataFrame) -> DataFrame:
    """Add `hits` and `is_miss` to rows that carry their ordinal, as `rate`, and slot columns.

    What was counted in the minute before is added to the rate.
    """
    return (
        ranked.withColumn("hits", F.col("hits_before") + F.col("rate"))
        .withColumn("is_miss", F.col("opens_session") & (F.col("rate") == 1))
        .withColumn("rate", F.col("rate_before") + F.col("rate"))
        .drop("opens_session", "hits_before", "rate_before")
    )


def slot_columns(slots: DataFrame) -> DataFrame:
    return slots.select(
        "ip", "minute", "session_start", "opens_session", "hits_before", "rate_before"
    )


def cache_sessions(requests: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per request: `rate`, `session_start`, `hits` (1 on a miss, +1 per hit), `is_miss`.

    Requests without ip or time have no session; `split_trackable` gives them.
    """
    requests, _ = split_trackable(requests)
    slots = durable(session_minutes(minute_activity(requests), settings))
    ranking = spread_for_ranking(requests, slots, settings)
    return drop_blocks(with_session_hits(rank_rows(ranking, slot_columns(slots))))


def active_reputation(
    requests: DataFrame,
    verdicts: DataFrame,
    as_of_ms: int,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Unexpired entries at `as_of_ms`. `verdicts` has (ip, session_start, score, class)."""
    sessions = reputation_sessions(requests.filter(F.col("ts_ms") <= as_of_ms), settings)
    live = sessions.filter(F.lit(as_of_ms) - F.col("last_seen") < settings.reputation_ttl_ms)
    return live.join(verdicts, SESSION_KEY).select("ip", "score", "class", "hits", "last_seen")


def upsert_reputation(current: DataFrame | None, touches: DataFrame) -> DataFrame:
    """Entries after writing `touches`; the latest whole value per ip wins.

    Both sides have the reputation columns. Equal times keep the higher hit count, which is
    the later touch of the same session.
    """
    columns = ["ip", "score", "class", "hits", "last_seen"]
    rows = touches.select(*columns)
    if current is not None:
        rows = rows.unionByName(current.select(*columns))
    value = F.struct("score", "class", "hits", "last_seen")
    return (
        rows.groupBy("ip")
        .agg(F.max_by(value, F.struct("last_seen", "hits")).alias("entry"))
        .select("ip", "entry.*")
    )
