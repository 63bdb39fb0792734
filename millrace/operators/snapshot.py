"""Incremental runs: what is reused, asked for, accumulated and dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates, text


def last_by_id(outcomes: DataFrame, pos: str = "outcome_index", key: str = "external_id") -> DataFrame:
    """The last row of each id; rows without one are left out."""
    rows = outcomes.where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), pos).alias("_last")).select(key, "_last.*")


def matched(posts: DataFrame, existing: DataFrame, retry_llm_errors: bool = True) -> DataFrame:
    """posts with cached: the last outcome of the same id (a struct) if its text is the same but for spacing, else null."""
    last = last_by_id(existing.withColumn("_text", text.collapse(F.coalesce("raw_text", "text"))))
    if retry_llm_errors:
        last = last.where("status != 'llm_error'")
    packed = last.select(F.col("external_id").alias("_id"), F.struct(*[c for c in last.columns if c != "external_id"]).alias("cached"))
    same = (F.col("external_id") == F.col("_id")) & (text.collapse(F.coalesce(posts["raw_text"], posts["text"])) == F.col("cached._text"))
    return posts.join(packed, same, "left").drop("_id")


def pending(posts: DataFrame, existing: DataFrame, retry_llm_errors: bool = True) -> DataFrame:
    """The posts that need a model, their places kept."""
    return matched(posts, existing, retry_llm_errors).where("cached is null").drop("cached")


def cached_ids(existing: DataFrame) -> DataFrame:
    return existing.select("external_id").where("external_id is not null").distinct()


def cutoffs(current: DataFrame) -> DataFrame:
    """owner, cutoff: the earliest current post of each wall, pinned ones aside."""
    rows = current.where(~F.coalesce("is_pinned", F.lit(False))).select(text.owner_of(F.col("external_id")).alias("owner"), dates.published_at_utc(F.col("published_at")).alias("at"))
    return rows.where("owner is not null and at is not null").groupBy("owner").agg(F.min("at").alias("cutoff"))


def accumulated(current: DataFrame, existing: DataFrame, prune: bool = False) -> DataFrame:
    """Current outcomes, then existing ones of other ids (rows without id always stay), with outcome_index anew in this order.

    prune: existing rows that a wall's current window should hold, but doesn't, are dropped.
    """
    old = existing.join(current.select("external_id"), "external_id", "left_anti")
    if prune:
        old = old.withColumn("owner", text.owner_of(F.col("external_id"))).join(cutoffs(current), "owner", "left")
        gone = F.coalesce(dates.published_at_utc(F.col("published_at")) >= F.col("cutoff"), F.lit(False))
        old = old.where(~gone).drop("owner", "cutoff")
    shift = current.agg(F.coalesce(F.max("outcome_index") + 1, F.lit(0))).first()[0]
    return current.unionByName(old.withColumn("outcome_index", F.col("outcome_index") + shift), allowMissingColumns=True)
