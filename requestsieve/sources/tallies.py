"""Counts over the log, kept up to date by batches: the dashboard's views read these.

Two small tables: requests by time span, class, source and country, and bots by time span and
client. Batches add spans of a minute; compaction rolls spans up that are no longer new, counts
to hours (the timeline needs the hour) and clients to hours and then days. A view takes the spans
that lie wholly within its range, and the rows of the log for what is before the first of them.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from requestsieve.functions.signals import MINUTE_MS, minute_bucket
from requestsieve.sources.batches import FAN_IN, BatchTable
from requestsieve.sources.log import log_day

HOUR, DAY = 60, 1440  # minutes


def _schema(*keys: str) -> T.StructType:
    longs = [T.StructField(c, T.LongType()) for c in ("start", "span", "n")]
    texts = [T.StructField(c, T.StringType()) for c in keys]
    return T.StructType([*longs, *texts, T.StructField("dt", T.DateType())])


@dataclass(frozen=True)
class Tally:
    """A table of counts by key. `spans` are (minutes after which, span that rows roll up to)."""

    table: BatchTable
    keys: tuple[str, ...]
    spans: tuple[tuple[int, int], ...]

    def counted(self, rows: DataFrame) -> DataFrame:
        """Counts by minute of log rows."""
        by_minute = rows.groupBy(minute_bucket(F.col("ts_ms")).alias("start"), *self.keys)
        return by_minute.agg(F.count(F.lit(1)).alias("n")).withColumn("span", F.lit(1).cast("long"))

    def add(self, rows: DataFrame, batch_id: int) -> None:
        self.table.write(self.counted(rows).withColumn("dt", _day(F.col("start"))), batch_id)

    def roll_up(self, rows: DataFrame) -> DataFrame:
        """Longer spans for older rows. They nest, so no two overlap in part."""
        newest = rows.agg(F.max("start")).first()[0]
        span = F.col("span")
        for age, minutes in self.spans:
            old = F.col("start") < F.lit(newest) - age
            span = F.when(old, F.greatest(span, F.lit(minutes))).otherwise(span)
        start = (F.col("start") - F.pmod(F.col("start"), F.col("span"))).alias("start")
        spanned = rows.withColumn("span", span.cast("long")).select(start, "span", *self.keys, "n")
        summed = spanned.groupBy("start", "span", *self.keys).agg(F.sum("n").alias("n"))
        return summed.withColumn("dt", _day(F.col("start")))

    def end_of_span_at(self, minute: int) -> int:
        """The minute after the longest span that holds this one; spans end with the day."""
        rows = self.table.read().filter(F.col("dt") == _day(F.lit(minute)))
        ends = F.col("start") + F.col("span")
        around = rows.filter((F.col("start") <= minute) & (ends > minute))
        return around.agg(F.max(ends)).first()[0] or minute + 1

    def since(self, minute: int) -> DataFrame:
        """Spans from this minute on."""
        rows = self.table.read().filter(F.col("dt") >= _day(F.lit(minute)))
        return rows.filter(F.col("start") >= minute).select("start", *self.keys, "n")


def _day(minute: Column) -> Column:
    return log_day(minute.cast("long") * MINUTE_MS)


class Tallies:
    """Both tables under a folder."""

    def __init__(self, spark: SparkSession, path: str):
        counts, bots = ("class", "source", "country"), ("ip",)
        self.counts = Tally(
            BatchTable(spark, f"{path}/counts", _schema(*counts), ("dt",)), counts, ((2 * HOUR, HOUR),)
        )
        self.bots = Tally(
            BatchTable(spark, f"{path}/bots", _schema(*bots), ("dt",)),
            bots,
            ((2 * HOUR, HOUR), (4 * DAY, DAY)),
        )

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Count a batch of log rows; a batch that runs again replaces its counts."""
        self.counts.add(rows, batch_id)
        self.bots.add(rows.filter(F.col("class") == "BOT"), batch_id)

    def compact(self, before: int, fan_in: int = FAN_IN) -> None:
        for tally in (self.counts, self.bots):
            tally.table.compact(before, tally.roll_up, fan_in)

    def read(self, log: DataFrame, since_ms: int) -> tuple[DataFrame, DataFrame]:
        """(hour, class, source, country, n) and (ip, n) of all log rows after `since_ms`.

        `log` is read for the rows between `since_ms` and the first whole span only.
        """
        edge = since_ms // MINUTE_MS
        first = max(t.end_of_span_at(edge) for t in (self.counts, self.bots))
        ahead = log.filter((F.col("ts_ms") > since_ms) & (F.col("ts_ms") < first * MINUTE_MS))
        if "dt" in log.columns:
            ahead = ahead.filter(F.col("dt") == log_day(F.lit(edge * MINUTE_MS)))
        counted = self.counts.since(first).unionByName(self._ahead(self.counts, ahead))
        bots = self.bots.since(first).unionByName(
            self._ahead(self.bots, ahead.filter(F.col("class") == "BOT"))
        )
        return counted.withColumn("hour", F.floor(F.col("start") / HOUR) % 24), bots

    @staticmethod
    def _ahead(tally: Tally, rows: DataFrame) -> DataFrame:
        return tally.counted(rows).select("start", *tally.keys, "n")
