"""Session set-up and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "airgrid", master: str | None = None, **conf) -> SparkSession:
    """Session with UTC time and adaptive execution; `conf` overrides (dots as `__`)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"airgrid-{application}-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode without a setting."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder(context.applicationId)


def settle(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` to the shared folder and read it back, by partition if asked.

    Cuts the lineage, outlives lost executors, and gives the planner the true size, so that Spark
    itself broadcasts the table when it is under `spark.sql.autoBroadcastJoinThreshold` and
    shuffles it otherwise.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/airgrid-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(df.columns)
    out._settled_in = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a settled frame that nothing will read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_in)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
