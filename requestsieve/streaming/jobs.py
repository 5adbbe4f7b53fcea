"""Streaming jobs: classify into sinks, and keep analytics live.

Micro-batches run the batch cascade: what is remembered of clients is a table of entries, read as
of the batch and written by it, so there is no state that a clock could expire, and a stream that
was down or lags behind gives what the batch job gives. Requests that are older than what was
already seen of their client are late: they are counted, and treated as hits, not dropped.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from requestsieve.operators.activity import drop_blocks
from requestsieve.operators.models import Model
from requestsieve.plans import analytics
from requestsieve.plans.cascade import Fingerprints
from requestsieve.plans.outputs import Sinks, remember, run_batch, track_batch
from requestsieve.settings import DEFAULTS, Settings
from requestsieve.sources.batches import BatchTable
from requestsieve.sources.clients import ClientStore
from requestsieve.sources.log import GOOD, STORED
from requestsieve.sources.tallies import Tallies

TRACKED = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("ip", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("minute", T.LongType()),
        T.StructField("rate", T.LongType()),
        T.StructField("session_start", T.LongType()),
        T.StructField("hits", T.LongType()),
        T.StructField("is_miss", T.BooleanType()),
    ]
)


def classify_stream(
    requests: DataFrame,
    folder: str,
    checkpoint: str,
    primary: Model,
    secondary: Model | None = None,
    fingerprints: Fingerprints | None = None,
    settings: Settings = DEFAULTS,
) -> DataStreamWriter:
    """Stream of signals -> all sinks under `folder`. The caller sets the trigger.

    A table-backed model must hold the answers of the rows it will be asked about.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        sinks = Sinks.at(batch.sparkSession, folder, settings)
        rows = batch.persist()
        try:
            run_batch(rows, batch_id, sinks, primary, secondary, fingerprints, settings)
        finally:
            rows.unpersist()

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)


def track_stream(
    requests: DataFrame, folder: str, checkpoint: str, settings: Settings = DEFAULTS
) -> DataStreamWriter:
    """Stream of signals -> rates and sessions under `folder`, without verdicts.

    Requests without ip or time have neither; `split_trackable` gives them.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clients = ClientStore(spark, f"{folder}/clients", settings)
        rows = batch.persist()
        try:
            if batch_id and batch_id % settings.snapshot_every == 0:
                clients.take_snapshot(batch_id - 1)
            tracked = track_batch(rows, batch_id, clients, settings)
            none = spark.createDataFrame([], "ip string, session_start long, score double, class string")
            remember(tracked, none, batch_id, clients)
            tracked_table(spark, folder).write(drop_blocks(tracked.rows), batch_id)
        finally:
            rows.unpersist()

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)


def tracked_table(spark: SparkSession, folder: str) -> BatchTable:
    return BatchTable(spark, f"{folder}/tracked", TRACKED)


def drain(writer: DataStreamWriter) -> None:
    """Process all available input, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


# --- live analytics ---------------------------------------------------------------------


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """The good rows of a log as they are appended, by batch; compacted folders hold nothing new.

    A batch that is written again is seen again: where that may happen, take the tallies that the
    cascade's own batches write.
    """
    stored = T.StructType([*STORED.fields, T.StructField("batch", T.StringType())])
    rows = spark.readStream.schema(stored).parquet(path)
    numbers = F.split("batch", "-")
    single = F.get(numbers, 0) == F.get(numbers, 1)
    return rows.filter(single & (F.col("kind") == GOOD)).drop("batch", "kind", "errors")


def tally_stream(log: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Stream of log rows -> tallies under `path`, rolled up as they get older.

    Late rows need no state: a batch counts what it has, and readers add up.
    `trigger(processingTime="5 seconds")` keeps a dashboard fresh.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        tallies = Tallies(batch.sparkSession, path)
        tallies.compact(batch_id)
        rows = batch.persist()
        try:
            tallies.add(rows, batch_id)
        finally:
            rows.unpersist()

    return log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)


def live_bundle(
    spark: SparkSession, path: str, log: DataFrame, hours: int, now_ms: int
) -> dict[str, DataFrame]:
    """Every view over streamed tallies, equal to the batch views for any `now_ms`.

    Of the log only the rows before the first whole span of the range are read, and the newest.
    """
    counted, bots = Tallies(spark, path).read(log, analytics.since_ms(hours, now_ms))
    return analytics.counting_views(counted, bots) | {"recent": analytics.recent(log)}
