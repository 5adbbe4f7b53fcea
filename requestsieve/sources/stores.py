"""Stored reputation entries and fingerprints."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from requestsieve.schemas import FINGERPRINT, REPUTATION
from requestsieve.sources.batches import BatchTable
from requestsieve.sources.clients import ClientStore

_VERSIONED = T.StructType([*FINGERPRINT.fields, T.StructField("version", T.LongType())])


def _newest(rows: DataFrame) -> DataFrame:
    """One row for each id, of the highest version. Ids that came once are not shuffled with
    their vectors: only (id, version) is grouped, and the few outdated rows are taken out."""
    stale = (
        rows.groupBy("id")
        .agg(F.max("version").alias("_newest"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select("id", "_newest")
    )
    same = (rows["id"] == stale["id"]) & (rows["version"] < stale["_newest"])
    return rows.join(stale, same, "left_anti")


class FingerprintStore:
    """Fingerprints by id: writing an id again replaces its row, whatever class it had.

    Batches add rows, divided by class so a search reads one class; reading keeps the newest of
    each id, and compaction leaves out what is outdated.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._table = BatchTable(spark, path, _VERSIONED, ("class",))

    def put(self, fresh: DataFrame, batch_id: int) -> None:
        """Write a batch's fingerprints, at most one for each id, replacing earlier attempts."""
        self._table.write(fresh.withColumn("version", F.lit(batch_id).cast("long")), batch_id)

    def read(self, before: int | None = None) -> DataFrame:
        """One row for each id, of all batches or of those before one."""
        return _newest(self._table.read(before=before)).select(*FINGERPRINT.fieldNames())

    def compact(self, before: int) -> None:
        self._table.compact(before, _newest)

    def is_empty(self, before: int | None = None) -> bool:
        return not any(before is None or p.last < before for p in self._table.parts())


def read_reputation(spark: SparkSession, path: str) -> DataFrame:
    """The latest entry of each client."""
    return ClientStore(spark, path).entries().select(*REPUTATION.fieldNames())


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return FingerprintStore(spark, path).read()
