"""What is remembered of each client between batches: its reputation entry and rate windows.

A table of the latest entry per client: a snapshot, bucketed and sorted by client, and the entries
of each batch since. A lookup joins the clients that a batch touches with both; the snapshot is
not shuffled. A snapshot is taken every so many batches and leaves out clients that have been
silent for longer than late requests may take to arrive.
"""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from requestsieve.schemas import REPUTATION
from requestsieve.settings import DEFAULTS, Settings
from requestsieve.sources.batches import BatchTable, Files

WINDOW = T.StructType(
    [
        T.StructField("minute", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("expiry_ms", T.LongType()),
    ]
)
# `windows` are the live rate windows, of the last minutes only.
ENTRY = T.StructType(
    [
        *REPUTATION.fields,
        T.StructField("session_start", T.LongType()),
        T.StructField("windows", T.ArrayType(WINDOW)),
    ]
)
_COLUMNS = ENTRY.fieldNames()
_VERSIONED = T.StructType([*ENTRY.fields, T.StructField("version", T.LongType())])


def latest(entries: DataFrame) -> DataFrame:
    """The entry of the highest version for each client."""
    value = F.struct(*[c for c in _COLUMNS if c != "ip"], "version")
    return entries.groupBy("ip").agg(F.max_by(value, "version").alias("e")).select("ip", "e.*")


class ClientStore:
    """Entries under a folder. Batches are numbered and run in order; one may run again."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = DEFAULTS):
        self.spark = spark
        self.path = path
        self.settings = settings
        self._deltas = BatchTable(spark, f"{path}/deltas", _VERSIONED)
        self._files = Files(spark, f"{path}/snapshots")

    # --- snapshots -------------------------------------------------------------------------

    def _snapshots(self) -> list[tuple[int, int, str]]:
        """(last batch in it, buckets, folder) of complete snapshots, oldest first."""
        names = [n for n in self._files.folders() if self._files.has(f"{n}/_SUCCESS")]
        return sorted((*map(int, n.removeprefix("upto=").split("-")), n) for n in names)

    def _snapshot_before(self, batch_id: int | None) -> tuple[int, DataFrame | None]:
        found = [s for s in self._snapshots() if batch_id is None or s[0] < batch_id]
        if not found:
            return -1, None
        upto, buckets, folder = found[-1]
        return upto, self.spark.table(self._bucketed(folder, buckets))

    def _bucketed(self, folder: str, buckets: int) -> str:
        """A table over a snapshot's folder. The bucket count is in the folder's name, so it is
        the one that the files were written with, whatever the session's settings are."""
        location = f"{self.path}/snapshots/{folder}"
        name = f"clients_{hashlib.md5(location.encode()).hexdigest()}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _VERSIONED.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
            f" CLUSTERED BY (ip) SORTED BY (ip) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        return name

    def take_snapshot(self, upto: int) -> None:
        """Write the entries after batch `upto`, without clients silent for too long.

        Deltas it replaces stay until the next one, for readers that have listed them.
        """
        done = self._snapshots()
        if done and done[-1][0] >= upto:
            return
        entries = self.entries(before=upto + 1, versioned=True)
        newest = entries.agg(F.max("last_seen")).first()[0]
        if newest is not None:
            kept_ms = self.settings.reputation_ttl_ms + self.settings.most_late_ms
            entries = entries.filter(F.col("last_seen") > newest - kept_ms)
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        folder = f"upto={upto}-{buckets}"
        self._files.remove(folder)
        name = self._bucketed(folder, buckets)
        entries.select(*_VERSIONED.fieldNames()).write.insertInto(name, overwrite=True)
        if done:
            self._deltas.remove_before(done[-1][0] + 1)
            for _, buckets, old in done[:-1]:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._bucketed(old, buckets)}")
                self._files.remove(old)

    # --- entries ---------------------------------------------------------------------------

    def lookup(self, clients: DataFrame, before: int) -> DataFrame:
        """Entries of these clients (distinct `ip`) as they were before batch `before`."""
        upto, snapshot = self._snapshot_before(before)
        recent = latest(self._deltas.read(since=upto + 1, before=before))
        names = [c for c in _COLUMNS if c != "ip"]
        found = clients.select("ip").join(
            recent.select("ip", F.struct(*names).alias("_recent")), "ip", "left"
        )
        value = F.col("_recent")
        if snapshot is not None:
            stored = snapshot.select("ip", F.struct(*names).alias("_stored"))
            found = found.join(stored, "ip", "left")
            value = F.coalesce("_recent", "_stored")
        return found.select("ip", value.alias("_e")).filter("_e IS NOT NULL").select("ip", "_e.*")

    def entries(self, before: int | None = None, versioned: bool = False) -> DataFrame:
        """All entries, or those before a batch. Also what `active_at` judges."""
        upto, snapshot = self._snapshot_before(before)
        rows = self._deltas.read(since=upto + 1, before=before)
        if snapshot is not None:
            rows = rows.unionByName(snapshot)
        return latest(rows).select(*_COLUMNS, *["version"] * versioned)

    def active_at(self, as_of_ms: int) -> DataFrame:
        """Entries that are not expired; with the reputation columns."""
        alive = F.lit(as_of_ms) - F.col("last_seen") < self.settings.reputation_ttl_ms
        return self.entries().filter(alive).select(*REPUTATION.fieldNames())

    def put(self, entries: DataFrame, batch_id: int) -> None:
        """Write the entries that a batch leaves; a batch that runs again replaces its own."""
        self._deltas.write(entries.withColumn("version", F.lit(batch_id).cast("long")), batch_id)
