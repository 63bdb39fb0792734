"""What the operators share: reading tables, keeping intermediate results, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the word pattern ``[^\x20\x09-\x0D]+``; bytes.split() splits at the same six.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode one of our own where it is unset; on a
    cluster that is an error, as executors wouldn't see a folder of the driver's."""
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


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def removed(spark: SparkSession) -> None:
    """Deletes all tables that kept() wrote to the shared folder; for when no result of theirs is read any more."""
    deleted(spark, f"{shared_dir(spark)}/millrace")


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet to the shared folder and read back.

    It cuts the lineage as checkpoint() does, survives lost executors, and, unlike checkpoint(), later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """df, which should be a kept table, marked for broadcast if it fits in limit bytes; beyond, Spark shuffles both sides.

    Its bytes are measured: rows as Spark holds them, 8 bytes a column and the contents of texts, and as much again for keys.
    """
    wide = [f.name for f in df.schema if f.dataType.typeName() not in ("long", "integer", "short", "byte", "double", "float", "boolean", "date", "timestamp", "timestamp_ntz")]
    contents = [F.octet_length(F.col(f"`{c}`").cast("string")) if df.schema[c].dataType.typeName() != "binary" else F.octet_length(F.col(f"`{c}`")) for c in wide]
    size = sum((F.coalesce(c, F.lit(0)) + 8 for c in contents), F.lit(16 + 8 * len(df.columns)))
    held = 2 * (df.agg(F.sum(size)).first()[0] or 0)
    return F.broadcast(df) if held <= limit else df


def with_columns(df: DataFrame, needed: dict[str, str]) -> DataFrame:
    """The needed columns alone, cast, so that further columns of the input can't clash with the operator's own."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in needed.items()])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024, text: str = "text", most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most that many rows and about that many bytes, a longer row being alone; empty batches are left out."""
    for batch in batches:
        at, n = 0, batch.num_rows
        while at < n:
            take = min(rows, n - at)
            while take > 1 and batch.slice(at, take).column(text).nbytes > most:
                take = (take + 1) // 2
            yield batch.slice(at, take)
            at += take


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts, null being empty."""
    return [x or "" for x in batch.column(text).to_pylist()]


_sole: dict = {}


def sole(name, make):
    """An operator's word cache in this Python worker. Workers run tasks of many operators; the caches of others are let go, so
    that one worker never holds more than one."""
    if name not in _sole:
        _sole.clear()
        _sole[name] = make()
    return _sole[name]


def fold_of(doc_id: int | None, folds: int) -> int:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def fold_column(doc_id: str, folds: int):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds
