"""Request sources, batch and stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from requestsieve.functions.signals import path_name
from requestsieve.schemas import RAW_REQUEST


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(RAW_REQUEST).format(fmt).load(path)


def stream_requests(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(RAW_REQUEST).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def classifiable(requests: DataFrame) -> DataFrame:
    """Requests that are counted, classified and logged.

    Preflights, the analytics endpoint and the health check are not. Fixed values: their
    method and paths.
    """
    name = path_name(F.col("url"))
    return requests.filter(
        (F.coalesce("method", F.lit("")) != "OPTIONS")
        & ~F.coalesce(name, F.lit("")).isin("/analytics", "/health")
    )
