"""Cheap checks before any model call: blank, repeated, error budget, daily limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import rules, text
from millrace.operators import blocks


def prompt_text(raw: str = "raw_text", plain: str = "text") -> Column:
    return F.coalesce(F.col(raw), F.col(plain))


def first_occurrences(posts: DataFrame, skip_empty: bool = True, skip_duplicates: bool = True) -> DataFrame:
    """posts with prompt_text, first_pos (of the same post, if it isn't the first) and repeat: empty_post, duplicate_post or null.

    Blank posts come first and are nobody's first occurrence.
    """
    posts = posts.withColumn("prompt_text", prompt_text())
    blank = (F.coalesce(text.strip(F.col("prompt_text")), F.lit("")) == "") & F.lit(skip_empty)
    posts = posts.withColumn("_blank", blank).withColumn("_key", text.post_key(F.when(~F.col("_blank"), F.col("external_id")), F.col("prompt_text")))
    # blank rows are keyed by place, so that they gather in no task
    posts = posts.withColumn("_key", F.when(F.col("_blank"), F.concat(F.lit("blank:"), F.col("post_pos"))).otherwise(F.col("_key")))
    if skip_duplicates:
        # the least place by key comes from partial minima, so that a post with many copies meets in no task
        first = posts.groupBy("_key").agg(F.min("post_pos").alias("first_pos"), F.count("*").alias("n")).where("n > 1").drop("n")
        posts = posts.join(first, "_key", "left").withColumn("first_pos", F.when(F.col("first_pos") < F.col("post_pos"), F.col("first_pos")))
    else:
        posts = posts.withColumn("first_pos", F.lit(None).cast("long"))
    repeat = F.when(F.col("_blank"), "empty_post").when(F.col("first_pos").isNotNull(), "duplicate_post")
    return posts.withColumn("repeat", repeat).drop("_key", "_blank")


def guarded(posts: DataFrame, today: Column | None = None, skip_empty: bool = True, skip_duplicates: bool = True) -> DataFrame:
    """posts with prompt_text, first_pos, and guard: why no model is asked, or null. Words of the text come after repeats."""
    today = F.current_date() if today is None else today
    posts = blocks.spread(first_occurrences(posts, skip_empty, skip_duplicates), "post_pos")
    return posts.withColumn("guard", F.coalesce("repeat", rules.skip_reason(F.col("prompt_text"), today))).drop("repeat")


def eligible(guard: Column) -> Column:
    """Whether the error budget and the daily latch concern a post: all but blank and repeated ones. Those that their words or the
    model skip are tested like the others, before they are looked at."""
    return ~F.coalesce(guard.isin("empty_post", "duplicate_post"), F.lit(False))


def running_before(df: DataFrame, value: str, pos: str = "pos", out: str = "before", width: int = 65536) -> DataFrame:
    """df with the sum of value over all rows of lesser pos (distinct, not negative).

    Sums of blocks of positions are added up first (a row for every `width` positions), then rows within their block, so that
    no task orders the whole table.
    """
    df = df.withColumn("_block", F.floor(F.col(pos) / width))
    sums = df.groupBy("_block").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_earlier", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, "_block").withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)) + F.col("_earlier")).drop("_block", "_earlier")


def with_limits(results: DataFrame, max_errors: int | None = None, pos: str = "pos") -> DataFrame:
    """results (pos, status, is_daily_limit, eligible) with status after the daily latch and the error budget.

    After the first daily limit all later eligible rows are llm_error and count as errors. An eligible row is skipped if as many
    errors as allowed came before it. Rows that aren't eligible stay as they are and count for nothing. Adds limit:
    daily_rate_limit_exceeded, error_limit_reached or null.
    """
    latch = results.where(F.col("eligible") & F.col("is_daily_limit")).agg(F.min(pos).alias("_latch"))
    df = results.withColumn("_latch", F.lit(latch.first()[0]).cast("long"))
    df = df.withColumn("_daily", F.coalesce(F.col("eligible") & (F.col(pos) >= F.col("_latch")), F.lit(False)))
    df = df.withColumn("_error", (F.col("eligible") & (F.col("_daily") | F.col("status").isin("invalid", "llm_error"))).cast("long"))
    if max_errors is not None:
        df = running_before(df, "_error", pos, "_before")
    over = F.col("eligible") & (F.col("_before") >= max_errors) if max_errors is not None else F.lit(False)
    df = df.withColumn("limit", F.when(over, "error_limit_reached").when(F.col("_daily"), "daily_rate_limit_exceeded"))
    df = df.withColumn("status", F.when(over, "skipped").when(F.col("_daily"), "llm_error").otherwise(F.col("status")))
    return df.drop("_latch", "_daily", "_error", "_before")
