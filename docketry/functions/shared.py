"""The folder that driver and executors share, and tables that are written there."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session that names none, as in tests, gets one here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    here = spark.sparkContext._jsc.sc().getCheckpointDir()
    if here.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "checkpoints", "docketry"))
        here = spark.sparkContext._jsc.sc().getCheckpointDir()
    return here.get().rstrip("/")


def stable(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder once and cuts its lineage there, so that what is made from it scans no source again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate data, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
