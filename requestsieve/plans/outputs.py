"""The cascade in batches: stored state in, verdicts, sinks and new state out.

A batch looks up what is remembered of its clients, classifies its requests, and writes what its
requests leave behind, so any division of a time-ordered input into batches gives the results of
one run over all of it. The same function serves a nightly job and a micro-batch.

Verdicts are committed first. A batch that runs again after a failure takes the verdicts it
committed, whatever a model would answer now, and every sink replaces the whole of its batch.
"""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from requestsieve.operators.activity import split_trackable
from requestsieve.operators.fingerprints import new_fingerprints
from requestsieve.operators.models import Model
from requestsieve.operators.reputation import SESSION_KEY, entries_after
from requestsieve.plans.cascade import (
    NO_FINGERPRINTS,
    Fingerprints,
    Tracked,
    carry_verdict,
    misses_of,
    resolve,
    track,
)
from requestsieve.schemas import LOG_COLUMNS
from requestsieve.settings import DEFAULTS, Settings
from requestsieve.sources.batches import BatchTable
from requestsieve.sources.clients import ClientStore
from requestsieve.sources.log import GOOD, log_rows, log_table
from requestsieve.sources.stores import FingerprintStore
from requestsieve.sources.tallies import Tallies

VERDICTS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("ip", T.StringType()),
        T.StructField("session_start", T.LongType()),
        T.StructField("country", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("class", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)
BATCHES = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("requests", T.LongType()),
        T.StructField("rejected", T.LongType()),
        T.StructField("misses", T.LongType()),
        T.StructField("late", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Sinks:
    """All that the cascade writes, under one folder.

    `log` has good and rejected rows, `clients` the reputation entries and rate windows,
    `batches` one row of counts for each batch.
    """

    verdicts: BatchTable
    log: BatchTable
    fingerprints: FingerprintStore
    clients: ClientStore
    batches: BatchTable
    tallies: Tallies

    @classmethod
    def at(cls, spark: SparkSession, folder: str, settings: Settings = DEFAULTS) -> "Sinks":
        return cls(
            BatchTable(spark, f"{folder}/verdicts", VERDICTS),
            log_table(spark, f"{folder}/log"),
            FingerprintStore(spark, f"{folder}/fingerprints"),
            ClientStore(spark, f"{folder}/reputation", settings),
            BatchTable(spark, f"{folder}/batches", BATCHES),
            Tallies(spark, f"{folder}/tallies"),
        )

    def own_index(self, batch_id: int) -> Fingerprints:
        """The fingerprints that earlier batches have stored."""
        if self.fingerprints.is_empty(batch_id):
            return NO_FINGERPRINTS
        return replace(NO_FINGERPRINTS, index=self.fingerprints.read(batch_id))

    def maintain(self, batch_id: int, settings: Settings = DEFAULTS) -> None:
        """Join what earlier batches wrote into fewer files. Nothing of this batch is touched."""
        if batch_id % settings.snapshot_every == 0 and batch_id > 0:
            self.clients.take_snapshot(batch_id - 1)
        # The last batch may have to run again, so its verdicts stay by themselves.
        self.verdicts.compact(batch_id)
        self.log.compact(batch_id)
        self.fingerprints.compact(batch_id)
        self.batches.compact(batch_id)
        self.tallies.compact(batch_id)


def track_batch(
    requests: DataFrame, batch_id: int, clients: ClientStore, settings: Settings = DEFAULTS
) -> Tracked:
    """Rates and sessions of a batch, going on from what is remembered of its clients."""
    return track(requests, settings, lambda ips: clients.lookup(ips, batch_id))


def remember(
    tracked: Tracked, verdicts: DataFrame, batch_id: int, clients: ClientStore
) -> None:
    """Store what a batch leaves of its clients. `verdicts` are those of its own misses."""
    columns = [*SESSION_KEY, "score", "class"]
    known = verdicts.select(*columns).unionByName(tracked.entries.select(*columns))
    clients.put(entries_after(tracked.slots, tracked.entries, known), batch_id)


def run_batch(
    requests: DataFrame,
    batch_id: int,
    sinks: Sinks,
    primary: Model,
    secondary: Model | None = None,
    fingerprints: Fingerprints | None = None,
    settings: Settings = DEFAULTS,
) -> None:
    """Classify one batch of signals and write all its sinks.

    Misses are matched with the index as it was before the batch, and resolved once.
    `fingerprints` None means the index that the batches themselves build up. Requests without
    ip or time have no verdict, so the log rejects them; those it takes and those it rejects
    are the input. `requests` is read several times, so it should be a table or persisted.
    """
    sinks.maintain(batch_id, settings)
    tracked = track_batch(requests, batch_id, sinks.clients, settings)
    if not sinks.verdicts.has(batch_id):
        if fingerprints is None:
            fingerprints = sinks.own_index(batch_id)
        storing = replace(fingerprints, keep_vectors=True)
        resolved = resolve(misses_of(tracked), primary, secondary, storing, settings)
        sinks.verdicts.write(
            resolved.select(
                "request_id",
                *SESSION_KEY,
                "country",
                "verdict.*",
                F.col("vector").cast("array<float>").alias("vector"),
            ),
            batch_id,
        )
    verdicts = sinks.verdicts.read(batch_id, batch_id + 1)
    remember(tracked, verdicts, batch_id, sinks.clients)

    fresh = verdicts.withColumn("ts_ms", F.col("session_start"))
    sinks.fingerprints.put(new_fingerprints(fresh), batch_id)

    value = F.struct("score", "class", "source", "reason").alias("verdict")
    remembered = tracked.entries.select(
        *SESSION_KEY,
        F.struct(
            "score", "class", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("reason")
        ).alias("verdict"),
    )
    carried = carry_verdict(tracked, verdicts.select(*SESSION_KEY, value).unionByName(remembered))
    _, untrackable = split_trackable(requests)
    undecided = untrackable.withColumns(
        {
            "score": F.lit(None).cast("double"),
            "class": F.lit(None).cast("string"),
            "source": F.lit(None).cast("string"),
        }
    ).select(*LOG_COLUMNS)
    late = tracked.entries.select("ip", F.col("last_seen").alias("_carried_ms"))
    logged = log_rows(carried.select(*LOG_COLUMNS).unionByName(undecided))
    sinks.log.write(logged, batch_id)

    own = sinks.log.read(batch_id, batch_id + 1)
    sinks.tallies.add(own.filter(F.col("kind") == GOOD), batch_id)
    counts = (
        own.select("ip", "ts_ms", "kind", "source")
        .join(late, "ip", "left")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(F.col("kind") != GOOD).alias("rejected"),
            F.count_if((F.col("kind") == GOOD) & (F.col("source") != "CACHE")).alias("misses"),
            F.count_if((F.col("kind") == GOOD) & (F.col("ts_ms") < F.col("_carried_ms"))).alias("late"),
        )
    )
    sinks.batches.write(counts.withColumn("batch_id", F.lit(batch_id).cast("long")), batch_id)


def write_outputs(
    requests: DataFrame,
    folder: str,
    primary: Model,
    secondary: Model | None = None,
    fingerprints: Fingerprints = NO_FINGERPRINTS,
    settings: Settings = DEFAULTS,
) -> None:
    """Classify the next batch under `folder`, the first one or one that goes on from others."""
    sinks = Sinks.at(requests.sparkSession, folder, settings)
    run_batch(
        requests, sinks.batches.next_batch(), sinks, primary, secondary, fingerprints, settings
    )
