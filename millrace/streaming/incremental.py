"""Posts as a stream: each micro-batch is an incremental run against the snapshot table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text


def first_occurrences(posts: DataFrame, watermark: str = "1 day", at: str = "published_ts") -> DataFrame:
    """A stream of posts without repeats within the watermark."""
    keyed = posts.withWatermark(at, watermark).withColumn("post_key", text.post_key(F.col("external_id"), F.coalesce("raw_text", "text")))
    return keyed.dropDuplicatesWithinWatermark(["post_key"]).drop("post_key")


def latest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The last whole snapshot in the folder (before batch `before`), or null; folders of batches that broke off are passed over."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("batch=")]
    done = [n for n in (int(p.getName()[6:]) for p in names if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))) if before is None or n < before]
    return spark.read.parquet(f"{folder}/batch={max(done)}") if done else None


def into_snapshots(posts: DataFrame, folder: str, run: Callable[[DataFrame, DataFrame | None], DataFrame], checkpoint: str, trigger: dict | None = None):
    """Start a query that, for each micro-batch, writes run(batch, last snapshot or None) to folder/batch=<n>.

    A batch that is run again overwrites its own folder and reads the last snapshot before it, so results are the same.
    """

    def step(batch: DataFrame, n: int) -> None:
        run(batch, latest(batch.sparkSession, folder, n)).write.mode("overwrite").parquet(f"{folder}/batch={n}")

    writer = posts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
