"""Exact deduplication over a persistent digest index.

The index is a table bucketed and sorted by SHA-256 digest. New data is reduced to one row per
digest, compared with the index by a sort-merge anti-join, and appended; neither side of a later
comparison is shuffled again on the index side. Texts are equal if their bytes are; null counts
as empty. Of equal texts the row with the largest doc_id stays; a null doc_id is smaller than
any other. Rows that also tie in doc_id are interchangeable and exactly one of them stays.
"""

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from requestsieve.llm.common import lookup, whole_text, written
from requestsieve.sources.batches import Files

GROUP = (
    "__rs_digest binary, __rs_keep bigint, __rs_ties bigint, __rs_size bigint, __rs_batch string"
)


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(whole_text(text), 256))


def digests_of(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("__rs_doc"), text_digest().alias("__rs_digest")
    )


class DigestIndex:
    """Digests seen so far: for each its largest doc_id, that id's rows, and the group size.

    Each batch adds one row per digest, all in one append, under its name; a batch that runs again
    under its name adds nothing. `groups` sums the rows of a digest up within its bucket. The
    bucket count is part of the folder's name, so an index keeps the one it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark = spark
        made = [n for n in Files(spark, path).folders() if n.startswith("buckets=")]
        self.buckets = (
            int(made[0].removeprefix("buckets="))
            if made
            else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        )
        self.path = f"{path}/buckets={self.buckets}"
        self.name = f"digests_{hashlib.md5(self.path.encode()).hexdigest()}"
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} ({GROUP}) USING parquet"
                " CLUSTERED BY (__rs_digest) SORTED BY (__rs_digest)"
                f" INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def groups(self, without: str | None = None) -> DataFrame:
        """One row per digest, of all batches but one. The bucketing serves both steps, so
        nothing is shuffled."""
        rows = self.rows()
        if without is not None:
            rows = rows.filter(F.col("__rs_batch") != without)
        return _one_per_digest(
            rows.groupBy("__rs_digest", F.col("__rs_keep").alias("__rs_doc"))
            .agg(F.sum("__rs_ties").alias("__rs_ties"), F.sum("__rs_size").alias("__rs_size"))
        )

    def add(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Add a batch (rows of __rs_digest, __rs_doc); returns its digests' groups, written.

        For each digest of the batch: the id that stays, the size of the whole group, its rows in
        the batch (`__rs_rows`), whether the row that stays is in this batch and in no earlier one
        (`__rs_own`), and how many rows of the batch tie for it (`__rs_ties`). An anti-join with
        the index finds the digests that are new; the others are joined with what is known.
        """
        batch = batch or uuid.uuid4().hex
        mine = written(
            _one_per_digest(
                digests.groupBy("__rs_digest", "__rs_doc")
                .agg(F.count(F.lit(1)).alias("__rs_ties"))
                .withColumn("__rs_size", F.col("__rs_ties"))
            ),
            "digests",
        )
        known = self.groups(without=batch).select(
            "__rs_digest",
            F.col("__rs_keep").alias("__rs_known_keep"),
            F.col("__rs_size").alias("__rs_known_size"),
        )
        fresh = mine.join(known.hint("merge"), "__rs_digest", "left_anti").select(
            "__rs_digest",
            "__rs_keep",
            "__rs_ties",
            "__rs_size",
            F.col("__rs_size").alias("__rs_rows"),
            F.lit(True).alias("__rs_own"),
        )
        keep, known_keep = F.col("__rs_keep"), F.col("__rs_known_keep")
        newer = keep.isNotNull() & (known_keep.isNull() | (keep > known_keep))
        again = mine.join(known.hint("merge"), "__rs_digest").select(
            "__rs_digest",
            F.greatest("__rs_keep", "__rs_known_keep").alias("__rs_keep"),
            "__rs_ties",
            (F.col("__rs_size") + F.col("__rs_known_size")).alias("__rs_size"),
            F.col("__rs_size").alias("__rs_rows"),
            newer.alias("__rs_own"),
        )
        groups = written(fresh.unionByName(again), "digests")
        if self.rows().filter(F.col("__rs_batch") == batch).isEmpty():
            self._append(mine.withColumn("__rs_batch", F.lit(batch)))
        return groups

    def _append(self, groups: DataFrame) -> None:
        (
            groups.repartition(self.buckets, "__rs_digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "__rs_digest")
            .sortBy("__rs_digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)


def _one_per_digest(by_doc: DataFrame) -> DataFrame:
    return by_doc.groupBy("__rs_digest").agg(
        F.max("__rs_doc").alias("__rs_keep"),
        F.coalesce(F.max_by("__rs_ties", "__rs_doc"), F.sum("__rs_ties")).alias("__rs_ties"),
        F.sum("__rs_size").alias("__rs_size"),
    )


def mark(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; adds `docs` to the index.

    Rows of earlier batches count in the groups; a row that an earlier batch holds in the same
    words and under the same id stays there. Rows equal in id and text are rebuilt from their
    count, the first of them kept. `batch` names the batch, so that it may run again.
    """
    digests = written(digests_of(docs), "digests")
    groups = index.add(digests, batch)
    values = ["__rs_keep", "__rs_ties", "__rs_size", "__rs_own"]
    found = lookup(digests, groups, "__rs_digest", "__rs_rows", values, F.col("__rs_doc"))
    is_best = F.col("__rs_doc").eqNullSafe(F.col("__rs_keep")) & F.col("__rs_own")
    single = found.filter(~is_best | (F.col("__rs_ties") == 1)).withColumn("__rs_kept", is_best)
    tied = (
        groups.filter("__rs_own AND __rs_ties > 1")
        .withColumn("__rs_doc", F.col("__rs_keep"))
        .withColumn("__rs_n", F.explode(F.sequence(F.lit(1), F.col("__rs_ties"))))
        .withColumn("__rs_kept", F.col("__rs_n") == 1)
        .select(single.columns)
    )
    return single.union(tied).select(
        F.col("__rs_doc").alias("doc_id"),
        F.col("__rs_keep").alias("keep_id"),
        F.col("__rs_size").alias("group_size"),
        F.col("__rs_kept").alias("kept"),
        F.lower(F.hex("__rs_digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of `docs` that stay, with their own columns; adds `docs` to the index.

    Rows that an earlier batch holds already, or that it outranks, do not stay.
    """
    added = index.add(written(digests_of(docs), "digests"), batch)
    groups = written(added.filter("__rs_size > 1 OR NOT __rs_own"), "digests")
    keyed = docs.withColumns(
        {"__rs_doc": F.col("doc_id").cast("long"), "__rs_digest": text_digest()}
    )
    values = ["__rs_keep", "__rs_ties", "__rs_own"]
    # Groups grow with the documents, so beyond the hot ones they are never broadcast.
    found = lookup(
        keyed, groups, "__rs_digest", "__rs_rows", values, F.col("__rs_doc"), far_hint="merge"
    )
    best = F.col("__rs_doc").eqNullSafe(F.col("__rs_keep")) & F.col("__rs_own")
    left = found.filter(F.col("__rs_ties").isNull() | best)
    if groups.filter("__rs_own AND __rs_ties > 1").isEmpty():
        return left.select(docs.columns)
    tied = F.coalesce(F.col("__rs_ties") > 1, F.lit(False))
    return (
        left.filter(~tied)
        .union(left.filter(tied).dropDuplicates(["__rs_digest"]))
        .select(docs.columns)
    )
