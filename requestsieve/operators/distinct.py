"""Do expensive work once per distinct key."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requestsieve.session import durable


def per_distinct(
    rows: DataFrame,
    key: str,
    compute: Callable[[DataFrame], DataFrame],
    unique_id: str = "request_id",
) -> DataFrame:
    """Left-join `compute(distinct keys)` back to `rows` on `key`.

    `compute` gets one column of distinct non-NULL keys and returns it with result columns,
    at most one row per key. Rows with a NULL key get NULL results. The results are kept on
    reliable storage, so neither a retry nor a later stage computes them again. `rows` is read
    twice, so it should be cheap to read.

    A key shared by very many rows makes a large partition on the `rows` side only, which
    Spark's skew-join handling splits, as the other side has one row per key. NULL keys would
    all meet in one partition too, so they are replaced by distinct texts that match nothing.
    """
    results = durable(compute(rows.filter(F.col(key).isNotNull()).select(key).distinct()))
    return join_results(rows, key, results, unique_id)


def join_results(
    rows: DataFrame, key: str, results: DataFrame, unique_id: str = "request_id"
) -> DataFrame:
    """Left-join results, one row per non-NULL key at most, to `rows`."""
    no_match = F.concat(F.lit("\u0000none:"), F.col(unique_id).cast("string"))
    keyed = rows.withColumn("_join_key", F.coalesce(F.col(key).cast("string"), no_match))
    results = results.withColumn("_join_key", F.col(key).cast("string")).drop(key)
    return keyed.join(results, "_join_key", "left").drop("_join_key")
