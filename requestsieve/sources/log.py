"""The classification log: append, validate, scan.

Every writer divides its rows in the same pass: those that satisfy the log's constraints are
`good`, the rest are `rejected` with the names of what they violate. Both are in one table of
numbered batches, divided by kind and day.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from requestsieve.schemas import LOG, LOG_COLUMNS
from requestsieve.settings import CLASSES, SOURCES
from requestsieve.sources.batches import BatchTable

DAY_MS = 86_400_000
STORED = T.StructType(
    [
        *LOG.fields,
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("kind", T.StringType()),
        T.StructField("dt", T.DateType()),
    ]
)
GOOD, REJECTED = "good", "rejected"


def log_day(ts_ms: Column) -> Column:
    """UTC day of a row, the partition of the log."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_ms / DAY_MS).cast("int"))


def log_errors() -> Column:
    """Names of the violated constraints; an empty array for a valid row."""
    checks = {
        "ip": F.col("ip").isNull(),
        "score": F.col("score").isNull(),
        "class": F.col("class").isNull() | ~F.col("class").isin(*CLASSES),
        "source": F.col("source").isNull() | ~F.col("source").isin(*SOURCES),
        "timestamp": F.col("ts_ms").isNull(),
    }
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks.items()]))


def validate_log(rows: DataFrame) -> DataFrame:
    """Add `errors`; NULL counts as a violation where the column is required."""
    return rows.withColumn("errors", log_errors())


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the log's constraints, and the rejected rest with `errors`."""
    checked = validate_log(rows)
    valid = checked.filter(F.size("errors") == 0).drop("errors")
    return valid, checked.filter(F.size("errors") > 0)


def log_rows(classified: DataFrame) -> DataFrame:
    """What is stored of classified rows: reason, rate and flags are not; the verdict on each
    row's constraints and its day are."""
    checked = validate_log(classified.select(*LOG_COLUMNS))
    bad = F.size("errors") > 0
    return checked.select(
        *LOG_COLUMNS,
        F.when(bad, F.col("errors")).alias("errors"),
        F.when(bad, REJECTED).otherwise(GOOD).alias("kind"),
        log_day(F.col("ts_ms")).alias("dt"),
    )


def log_table(spark: SparkSession, path: str) -> BatchTable:
    """Rows are sorted by client within files, so lookups of one skip row groups."""
    return BatchTable(spark, path, STORED, ("kind", "dt"), ("ip", "ts_ms"))


def append_log(rows: DataFrame, path: str) -> int:
    """Append to the log as a batch of its own; returns its number."""
    table = log_table(rows.sparkSession, path)
    batch_id = table.next_batch()
    table.write(log_rows(rows), batch_id)
    return batch_id


def append_log_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Append one micro-batch; writing the same batch again replaces it."""
    log_table(rows.sparkSession, path).write(log_rows(rows), batch_id)


def read_log(
    spark: SparkSession, path: str, since_ms: int | None = None, keep_day: bool = True
) -> DataFrame:
    """The good rows, or those after `since_ms`; the day filter prunes partitions.

    With the day kept, ranged views and `recent` prune partitions by themselves.
    """
    log = log_table(spark, path).read().filter(F.col("kind") == GOOD)
    if since_ms is not None:
        log = log.filter(
            (F.col("dt") >= log_day(F.lit(since_ms))) & (F.col("ts_ms") > since_ms)
        )
    return log.select(*LOG_COLUMNS, *["dt"] * keep_day)


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """Rows that the log did not take, with the constraints they violate."""
    rejected = log_table(spark, path).read().filter(F.col("kind") == REJECTED)
    return rejected.select(*LOG_COLUMNS, "errors")
