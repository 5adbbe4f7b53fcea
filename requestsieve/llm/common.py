"""Helpers that the training-data operators share.

Names starting with ``__rs_`` are internal, so columns of the input never clash with them.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from requestsieve.session import configure, shared_folder

# A word, as Java and Python read it.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, whose rows go to Python in batches of at most 8 MB, however long the texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


def whole_text(text: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Computed once and kept in the shared folder, with known size for the optimizer."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(text: str = "text") -> list[Column]:
    """Tells rows apart by id and text; rows equal in both are interchangeable."""
    return [
        F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("__rs_id"),
        F.xxhash64(F.col("doc_id"), F.col(text)).alias("__rs_row"),
    ]


ROW_KEY = ["__rs_id", "__rs_row"]


def chunk_bits(spark: SparkSession, floor: int = 6) -> int:
    """Bits of a hash that cut a hot group into a few pieces for each shuffle partition."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, (4 * partitions - 1).bit_length())


def running(
    rows: DataFrame,
    by: Sequence[str],
    chunk: str,
    order: Sequence[str],
    size: str,
    start: str = "__rs_start",
    rank: str = "__rs_rank",
) -> DataFrame:
    """Sum of `size` (as `start`) and number of rows (as `rank`) before each row of its group.

    Rows of a group are ordered by chunk, then by `order`. Only a chunk is sorted in one task;
    the sums of whole chunks are added from a small table, so a hot group is many tasks. `by`
    and `chunk` hold no nulls.
    """
    keys = [*by, chunk]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(
        F.sum(size).alias("__rs_sum"), F.count(F.lit(1)).alias("__rs_count")
    )
    offsets = sums.select(
        *keys,
        F.coalesce(F.sum("__rs_sum").over(ahead), F.lit(0)).alias("__rs_sums_before"),
        F.coalesce(F.sum("__rs_count").over(ahead), F.lit(0)).alias("__rs_count_before"),
    )
    return (
        rows.withColumns(
            {
                "__rs_in": F.coalesce(F.sum(size).over(within), F.lit(0)),
                "__rs_at": F.count(F.lit(1)).over(within),
            }
        )
        .join(offsets, keys)
        .withColumns(
            {
                start: F.col("__rs_in") + F.col("__rs_sums_before"),
                rank: F.col("__rs_at") + F.col("__rs_count_before"),
            }
        )
        .drop("__rs_in", "__rs_at", "__rs_sums_before", "__rs_count_before")
    )


def small_side(table: DataFrame, most: int = 200_000) -> DataFrame:
    """`table` to be broadcast in a join if it has at most so many (narrow) rows; else as it is,
    for a join by shuffle. It is counted first, so it should be written."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    count: str,
    values: Sequence[str],
    spread: Column,
    hot: int = 2000,
    far_hint: str | None = None,
) -> DataFrame:
    """`rows` with the `values` that `table` has for their key (unique there, no nulls).

    `count` is the number of rows with a key. Keys with over 1 in `hot` of all rows are fewer
    than `hot`, so they are broadcast; the others are joined by a shuffle without hot keys.
    `spread` deals the rows of hot keys over all tasks. `table` is read three times. `far_hint`
    fixes the kind of the second join; else Spark chooses it by size.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    often = table.filter(F.col(count) * hot > total)
    near = often.select(
        key,
        *[F.col(v).alias(f"__rs_near_{v}") for v in values],
        F.lit(True).alias("__rs_hot"),
    )
    far = table.filter(F.col(count) * hot <= total).select(
        key, *[F.col(v).alias(f"__rs_far_{v}") for v in values], F.lit(0).alias("__rs_salt")
    )
    far = far if far_hint is None else far.hint(far_hint)
    salt = F.when(F.col("__rs_hot"), 1 + F.pmod(F.hash(spread), F.lit(4096))).otherwise(0)
    found = (
        rows.join(F.broadcast(near), key, "left")
        .withColumn("__rs_salt", salt)
        .join(far, [key, "__rs_salt"], "left")
    )
    kept = [F.col(c) for c in rows.columns if c not in values]
    return found.select(
        *kept, *[F.coalesce(f"__rs_near_{v}", f"__rs_far_{v}").alias(v) for v in values]
    )
