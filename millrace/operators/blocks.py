"""Many pairs from few: rows of equal keys are packed into blocks, blocks meet, and a task unpacks the pairs of two blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About so many rows of a block; a task has the pairs of two blocks in memory at once.
BLOCK = 256


def tasks(df: DataFrame) -> int:
    """How many tasks a step takes whose work doesn't follow its bytes. A number that is given stays, while Spark joins partitions
    of few bytes into one."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df in as many tasks as the session takes, for steps that are long for few bytes."""
    # by a hash of its own: where rows lie by key already, Spark would leave this out and join their partitions after all
    return df.repartition(tasks(df), F.xxhash64(key))


def numbered(rows: DataFrame, pos: str, keys: list[str], width: int = BLOCK) -> DataFrame:
    """rows with block: those of equal keys dealt to blocks of about `width` by their places, and blocks: how many there are. Nulls
    are keys too."""
    counts = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.ceil(F.count("*") / width).alias("blocks"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(counts, same).drop(*[f"_{k}" for k in keys]).withColumn("block", F.pmod(F.xxhash64(pos), F.col("blocks")))


def packed(rows: DataFrame, pos: str, keys: list[str]) -> DataFrame:
    """keys, block, and places: the rows of a block by pos."""
    return numbered(rows.select(*keys, pos), pos, keys).groupBy(*keys, "block").agg(F.collect_list(pos).alias("places"))


def unpacked(met: DataFrame, left: str, right: str, where: Column, *columns: str) -> DataFrame:
    """p, q, columns: each place of the array left with each of the array right, where `where` holds of p, q and met's columns."""
    dealt = met.repartition(tasks(met), F.xxhash64(*[c for c in met.columns if c not in (left, right)]))
    first = dealt.withColumn("p", F.explode(left))
    return first.withColumn("q", F.explode(right)).where(where).select("p", "q", *columns)
