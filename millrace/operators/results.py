"""Reading results: flat events, counts, dropping an event, comparison with labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat_events(outcomes: DataFrame) -> DataFrame:
    """A row for each event of an extracted outcome: outcome_index, event_index, event."""
    rows = outcomes.where("status = 'extracted'").select("outcome_index", F.posexplode("events").alias("event_index", "event"))
    return rows.withColumn("event_index", F.col("event_index").cast("long"))


def status_counts(outcomes: DataFrame) -> DataFrame:
    """One row: total, one count for each status, error_count, and cached and processed if there is a column cached."""
    count = lambda status: F.count_if(F.col("status") == status)
    columns = [F.count("*").alias("total"), count("extracted").alias("extracted"), count("skipped").alias("skipped"), count("invalid").alias("invalid"), count("llm_error").alias("llm_errors")]
    columns.append((count("invalid") + count("llm_error")).alias("error_count"))
    if "cached" in outcomes.columns:
        cached = F.count_if(F.coalesce("cached", F.lit(False)))
        columns += [cached.alias("cached"), (F.count("*") - cached).alias("processed")]
    return outcomes.agg(*columns)


def drop_event(outcomes: DataFrame, outcome_index: int, event_index: int = 0) -> DataFrame:
    """Without one event; an outcome that loses its last one is skipped as dropped_by_user. No such event is an IndexError."""
    (row,) = outcomes.where(F.col("outcome_index") == outcome_index).select(F.size("events").alias("n"), "status").take(1) or [None]
    if row is None or row.status != "extracted" or not 0 <= event_index < row.n:
        raise IndexError("no such event")
    here = F.col("outcome_index") == outcome_index
    left = F.when(here, F.filter("events", lambda e, k: k != event_index)).otherwise(F.col("events"))
    none = here & (F.size("events") == 1)
    dropped = F.array(F.struct(F.lit("event").alias("field"), F.lit("dropped_by_user").alias("code"), F.lit("dropped_by_user").alias("message")))
    return outcomes.withColumns({"events": F.when(~none, left), "status": F.when(none, "skipped").otherwise(F.col("status")), "errors": F.when(none, dropped).otherwise(F.col("errors"))})


def single_event(outcome: DataFrame) -> DataFrame:
    """The events of outcomes that must all be extracted; any other raises."""
    bad = outcome.where("status != 'extracted'").select("status", "errors").first()
    if bad is not None:
        raise ValueError(f"{bad.status}: {bad.errors}")
    return flat_events(outcome)


def compared(outcomes: DataFrame, labels: DataFrame, key: str = "external_id") -> DataFrame:
    """key, status, expected_status, mismatch; a row without label is a mismatch."""
    rows = outcomes.select(key, "status").join(labels.select(key, "expected_status"), key, "left")
    return rows.withColumn("mismatch", ~F.col("status").eqNullSafe(F.col("expected_status")))


def accuracy(comparison: DataFrame) -> DataFrame:
    """One row: total, mismatches, accuracy (1 if there are no rows)."""
    bad = F.count_if("mismatch")
    return comparison.agg(F.count("*").alias("total"), bad.alias("mismatches"), F.coalesce((F.count("*") - bad) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("accuracy"))


def gold_summary(labels: DataFrame, first: int | None = None, pos: str = "post_pos") -> DataFrame:
    """expected_status, n: of all labels, or of the first so many by place."""
    rows = labels if first is None else labels.where(F.col(pos).isNotNull()).orderBy(pos).limit(first)
    return rows.groupBy("expected_status").agg(F.count("*").alias("n"))


def mismatches(comparison: DataFrame, key: str = "external_id", most: int = 20) -> DataFrame:
    """The first mismatches by key, for a report."""
    return comparison.where("mismatch").orderBy(key).limit(most)


def gate(comparison: DataFrame, allowed: int = 0) -> DataFrame:
    """accuracy() of a comparison, which may have so many mismatches; more are an error that names the first ones."""
    found = accuracy(comparison)
    n = found.first().mismatches
    if n > allowed:
        key = comparison.columns[0]
        raise ValueError(f"{n} mismatches, {allowed} allowed: {[tuple(r)[:3] for r in mismatches(comparison, key).collect()]}")
    return found


def dates_compared(outcomes: DataFrame, expected: DataFrame, key: str = "external_id") -> DataFrame:
    """key, same: whether the ordered (start, end) pairs of an outcome are the expected ones (column dates, of the same structs)."""
    own = F.transform("events", lambda e: F.struct(e["start_at"].alias("start_at"), e["end_at"].alias("end_at")))
    return outcomes.select(key, own.alias("own")).join(expected.select(key, "dates"), key).select(key, F.col("own").eqNullSafe(F.col("dates")).alias("same"))
