"""Session set-up and reliable materialisation."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that results depend on.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of failing the parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode.

    Executors of a cluster would each write a temporary folder to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if root is None and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = root or tempfile.mkdtemp(prefix="requestsieve-")
        context.setCheckpointDir(root)
    return root or context.getCheckpointDir()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    return f"{checkpoint_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Computed once, kept on reliable storage, so a lost executor recomputes nothing."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As `durable`, for wide rows: compressed columns, of which readers take those they need."""
    path = shared_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
