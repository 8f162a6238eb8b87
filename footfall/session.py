"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from functools import cache

from pyspark.sql import SparkSession

# Runtime settings every job of the package relies on. The shuffle width stays
# with the cluster; adaptive execution merges small partitions and splits skewed
# join partitions.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@cache
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="footfall-")
    warnings.warn(f"spark.checkpoint.dir is not set; intermediate tables go to {root}", stacklevel=3)
    return root


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below the one named in ``spark.checkpoint.dir``.

    On a cluster that setting must exist, since executors on other machines have
    to see what is written. In local mode a temporary folder stands in for it,
    with a warning.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/footfall/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for an intermediate table of this application."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are out."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, label: str):
    """Write a table to the shared folder and read it back.

    Used where several passes need one expensive table: the written copy is a
    lineage cut that survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
