"""Tables that a session writes for itself, in a folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this machine in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"codequarry-{os.getuid()}")
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder that is deleted when the process ends."""
    path = f"{shared_dir(spark)}/codequarry-{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df once, and read it from there; a table that is small on disk is then known to be."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    _left.pop(path, None)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_left.items()):
        try:
            delete(spark, path)
        except Exception:  # the session may be gone
            _left.clear()
            return
