"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read back: lineage is cut, and lost executors take nothing along.

    The tables stay until removed() is called or the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_dir(spark) -> str:
    """spark.checkpoint.dir; in local mode a folder of our own where it is unset, on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def removed(spark) -> None:
    """Deletes all tables that kept() wrote for this folder; for when no result of theirs is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/millrace")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
