"""Dashboard queries over the classification log.

All take the log with `ts_ms`; ranges are strict (`ts_ms > since`) and open-ended. Ties,
which the rules leave open, are broken by key so results are stable.
"""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from requestsieve.functions.text import to_fixed
from requestsieve.settings import CLASSES, SOURCES
from requestsieve.sources.log import log_day

HOUR_MS = 3_600_000
DEFAULT_HOURS = 24
# How long the lists are, and the ranges a dashboard offers.
TOP_IPS = 10
TOP_COUNTRIES = 20
RECENT_ROWS = 50
RANGES = ("1h", "6h", "24h", "72h")


def parse_range(text: str | None) -> int:
    """Hours of a range such as '6h'. No number, or zero, means 24.

    Only the leading integer counts, after dropping the first 'h' anywhere, so '7d' is 7.
    """
    number = re.match(r"\s*([+-]?\d+)", (text or "24h").replace("h", "", 1), re.ASCII)
    return (int(number.group(1)) if number else 0) or DEFAULT_HOURS


def since_ms(hours: int, now_ms: int) -> int:
    return now_ms - hours * HOUR_MS


def in_range(log: DataFrame, hours: int, now_ms: int) -> DataFrame:
    """Rows after the start of the range. The day of a stored log prunes its partitions."""
    since = since_ms(hours, now_ms)
    ranged = log.filter(F.col("ts_ms") > since)
    return ranged.filter(F.col("dt") >= log_day(F.lit(since))) if "dt" in log.columns else ranged


def hour_of_day(ts_ms: Column) -> Column:
    return F.floor(ts_ms / HOUR_MS) % 24


def _count_if(condition: Column, n: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, n).otherwise(0)), F.lit(0))


def _bot_and_legit(n: Column) -> list[Column]:
    return [
        _count_if(F.col("class") == "BOT", n).alias("bot"),
        _count_if(F.col("class") == "LEGITIMATE", n).alias("legit"),
    ]


def _zero_filled(counts: DataFrame, name: str, values: tuple[str, ...]) -> DataFrame:
    """Counts for the fixed values, 0 where absent; other values are kept."""
    spark = counts.sparkSession
    fixed = spark.range(1).select(
        F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    ).withColumn("n", F.lit(0).cast("long"))
    return counts.unionByName(fixed).groupBy(name).agg(F.sum("n").alias("n"))


def tally(log: DataFrame) -> DataFrame:
    """Rows per (hour of day, class, source, country): all the grouped views but the top
    clients come from this one small table, so the log is read once for them."""
    return log.groupBy(
        hour_of_day(F.col("ts_ms")).alias("hour"), "class", "source", "country"
    ).agg(F.count(F.lit(1)).alias("n"))


def _total(tallied: DataFrame) -> DataFrame:
    return tallied.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def _breakdown(tallied: DataFrame, name: str, values: tuple[str, ...]) -> DataFrame:
    counts = tallied.groupBy(name).agg(F.sum("n").alias("n"))
    return _zero_filled(counts, name, values)


def _by_country(tallied: DataFrame) -> DataFrame:
    return (
        tallied.groupBy("country")
        .agg(*_bot_and_legit(F.col("n")))
        .orderBy(F.desc("bot"), F.asc_nulls_last("country"))
        .limit(TOP_COUNTRIES)
    )


def _timeline(tallied: DataFrame) -> DataFrame:
    return tallied.groupBy("hour").agg(*_bot_and_legit(F.col("n"))).orderBy("hour")


def _counted(log: DataFrame) -> DataFrame:
    return log.withColumn("n", F.lit(1).cast("long"))


def total(log: DataFrame, hours: int, now_ms: int) -> DataFrame:
    return in_range(log, hours, now_ms).agg(F.count(F.lit(1)).alias("total"))


def class_breakdown(log: DataFrame, hours: int, now_ms: int) -> DataFrame:
    return _breakdown(_counted(in_range(log, hours, now_ms)), "class", CLASSES)


def source_breakdown(log: DataFrame, hours: int, now_ms: int) -> DataFrame:
    return _breakdown(_counted(in_range(log, hours, now_ms)), "source", SOURCES)


def top_bot_ips(log: DataFrame, hours: int, now_ms: int) -> DataFrame:
    bots = _counted(in_range(log, hours, now_ms)).filter(F.col("class") == "BOT")
    return _top_ips(bots)


def _top_ips(counted_bots: DataFrame) -> DataFrame:
    return (
        counted_bots.groupBy("ip")
        .agg(F.sum("n").alias("hits"))
        .orderBy(F.desc("hits"), "ip")
        .limit(TOP_IPS)
    )


def by_country(log: DataFrame, hours: int, now_ms: int) -> DataFrame:
    """Bots and legitimate requests per country; a NULL country is a group of its own."""
    return _by_country(_counted(in_range(log, hours, now_ms)))


def timeline(log: DataFrame, hours: int, now_ms: int) -> DataFrame:
    """Per UTC hour of day. Ranges beyond a day fold days together."""
    rows = _counted(in_range(log, hours, now_ms))
    return _timeline(rows.withColumn("hour", hour_of_day(F.col("ts_ms"))))


def newest_days(log: DataFrame, rows: int) -> DataFrame:
    """The last days of a stored log that hold `rows` rows between them; all, if it has fewer.

    Days are known from the paths of its partitions. Their rows are counted from file footers,
    newest day first, and mostly one day is enough.
    """
    pattern = re.compile(r"/dt=(\d{4,}-\d\d-\d\d)/")
    days = sorted({m[1] for m in map(pattern.search, log.inputFiles()) if m}, reverse=True)
    found = 0
    for day in days:
        found += log.filter(F.col("dt") == F.lit(day).cast("date")).count()
        if found >= rows:
            return log.filter(F.col("dt") >= F.lit(day).cast("date"))
    return log


def recent(log: DataFrame) -> DataFrame:
    """The newest rows, whatever the range. Of a stored log only the newest days are read."""
    if "dt" in log.columns:
        log = newest_days(log, RECENT_ROWS).drop("dt")
    return log.orderBy(F.desc("ts_ms"), F.desc("request_id")).limit(RECENT_ROWS)


def counting_views(counted: DataFrame, bots: DataFrame) -> dict[str, DataFrame]:
    """All views but `recent`, from rows that stand for `n` requests each.

    `counted` has hour, class, source, country; `bots` has ip and only BOT rows.
    """
    return {
        "total": _total(counted),
        "breakdown": _breakdown(counted, "class", CLASSES),
        "source_breakdown": _breakdown(counted, "source", SOURCES),
        "top_bot_ips": _top_ips(bots),
        "by_country": _by_country(counted),
        "timeline": _timeline(counted),
    }


def analytics_bundle(log: DataFrame, hours: int, now_ms: int) -> dict[str, DataFrame]:
    """Every view of the dashboard."""
    ranged = in_range(log, hours, now_ms)
    bots = _counted(ranged.filter(F.col("class") == "BOT"))
    return counting_views(tally(ranged), bots) | {"recent": recent(log)}


def bundle_rows(bundle: dict[str, DataFrame]) -> DataFrame:
    """The views as one table (section, label, n, bot, legit).

    One query for all of them: the shared tally is aggregated once. A recent row has its request
    id as label and its time as `n`.
    """

    def section(name: str, label: Column, **values: Column) -> DataFrame:
        numbers = [
            values.get(c, F.lit(None)).cast("long").alias(c) for c in ("n", "bot", "legit")
        ]
        return bundle[name].select(
            F.lit(name).alias("section"), label.cast("string").alias("label"), *numbers
        )

    pair = {"bot": F.col("bot"), "legit": F.col("legit")}
    parts = [
        section("total", F.lit("total"), n=F.col("total")),
        section("breakdown", F.col("class"), n=F.col("n")),
        section("source_breakdown", F.col("source"), n=F.col("n")),
        section("top_bot_ips", F.col("ip"), n=F.col("hits")),
        section("by_country", F.col("country"), **pair),
        section("timeline", F.col("hour"), **pair),
        section("recent", F.col("request_id"), n=F.col("ts_ms")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def top_bot_share(top_ips: DataFrame) -> DataFrame:
    """Hits as a percentage of the leader's; over the ten rows of `top_bot_ips`."""
    leader = F.max("hits").over(Window.partitionBy())
    return top_ips.withColumn("share", F.col("hits") / leader * 100.0)


def recent_display(recent_rows: DataFrame) -> DataFrame:
    """Feed columns: whole-percent score, style class, badge."""
    style = F.when(F.col("class").isin(*CLASSES), F.col("class")).otherwise("SUSPICIOUS")
    return recent_rows.select(
        "request_id",
        "ip",
        "country",
        "path",
        "source",
        "class",
        "ts_ms",
        style.alias("style"),
        F.when(F.col("source") == "VECTOR", "VECTOR").otherwise(style).alias("badge"),
        F.concat(to_fixed(F.col("score") * 100, 0), F.lit("%")).alias("score_percent"),
    )


def timeline_labels(timeline_rows: DataFrame) -> DataFrame:
    return timeline_rows.select(
        F.concat(F.col("hour").cast("string"), F.lit(":00")).alias("hour"),
        F.col("bot").alias("Bot"),
        F.col("legit").alias("Legitimate"),
    )


def country_chart(country_rows: DataFrame) -> DataFrame:
    return country_rows.select(
        "country", F.col("bot").alias("Bot"), F.col("legit").alias("Legitimate")
    )
