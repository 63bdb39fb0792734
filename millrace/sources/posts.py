"""Posts and snapshots in files."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.schemas import ERRORS, EVENT, MERGE, OUTCOME, POST


def json_posts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Posts of a JSON file that holds one list, in its order; the first `limit` of them.

    One list is one document, which one task reads; for more than a file's worth use tables of POST's columns.
    """
    raw = spark.read.text(path, wholetext=True)
    listed = raw.select(F.posexplode(F.from_json("value", f"array<{_fields()}>")).alias("post_pos", "p"))
    posts = listed.select(F.col("post_pos").cast("long").alias("post_pos"), *[F.col(f"p.{f.name}") for f in POST if f.name != "post_pos"])
    posts = normalized(posts)
    return posts.where(F.col("post_pos") < limit) if limit is not None else posts


def _fields() -> str:
    return "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in POST if f.name != "post_pos") + ">"


def normalized(posts: DataFrame) -> DataFrame:
    """Stripped texts, null for blank optional columns, is_pinned false by default. A blank text is an error, as for a reader of
    single posts."""
    stripped = text.strip(F.col("text"))
    checked = F.when(stripped != "", stripped).otherwise(F.raise_error(F.lit("text must not be blank")))
    optional = {c: text.blank_to_null(F.col(c)) for c in ("source_name", "source_url", "external_id", "raw_text")}
    return posts.withColumns(optional | {"text": checked, "is_pinned": F.coalesce("is_pinned", F.lit(False))})


def selected(posts: DataFrame, ids: list[str]) -> DataFrame:
    """The posts of these ids, in their order; an id without a post is an error."""
    spark = posts.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "post_pos long, external_id string")
    missing = [r.external_id for r in wanted.join(posts, "external_id", "left_anti").collect()]
    if missing:
        raise ValueError(f"no posts of {', '.join(missing)}")
    return posts.drop("post_pos").join(F.broadcast(wanted), "external_id").select(*POST.names)


def save_snapshot(outcomes: DataFrame, path: str) -> None:
    """outcomes as Parquet, a new folder each run: an old snapshot is never half overwritten."""
    outcomes.write.mode("errorifexists").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _exported(row: dict) -> dict:
    """An outcome in the exchange format: one event, or a list of several; its post; metadata with what became of it later."""
    events = row.get("events") or []
    notes = json.loads(row["metadata"]) if row.get("metadata") else {}
    if row.get("cached") is not None:
        notes |= {"incremental_cached": row["cached"], "source_index": row["outcome_index"]}
    notes |= {f"duplicate_event_merge{'_' + k if k != 'status' else ''}": v for k, v in (row.get("merge") or {}).items() if v is not None}
    post = {f.name: row.get(f.name) for f in POST if f.name != "post_pos"}
    return {"status": row["status"], "event": events[0] if events else None, "events": events if len(events) > 1 else None, "post": post, "errors": row.get("errors") or [], "raw_llm_metadata": notes or None}


def save_json(outcomes: DataFrame, path: str) -> None:
    """One JSON file on the driver, for exchange, row by row: {"outcomes": [...], and the counts of each status}. The driver holds
    a row at a time; readers of such a file may hold it whole, so larger results belong in save_snapshot()."""
    rows = outcomes.orderBy("outcome_index").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    seen: Counter = Counter()
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"outcomes": [')
        for k, r in enumerate(rows.toLocalIterator()):
            row = json.loads(r.j)
            seen[row["status"]] += 1
            f.write((",\n" if k else "\n") + json.dumps(_exported(row), ensure_ascii=False))
        counts = {"total": seen.total(), **{s: seen[s] for s in ("extracted", "skipped", "invalid")}, "llm_errors": seen["llm_error"], "error_count": seen["invalid"] + seen["llm_error"]}
        f.write("\n], " + json.dumps(counts)[1:] + "\n")


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Outcome rows (OUTCOME's columns) of such a file; a file of another shape is an error."""
    event, errors = EVENT.simpleString(), ERRORS.simpleString()
    one = f"struct<status:string,event:{event},events:array<{event}>,post:{_fields()},errors:{errors},raw_llm_metadata:string>"
    body = spark.read.schema(f"outcomes array<{one}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = body.select(F.posexplode("outcomes").alias("outcome_index", "o"))
    note = lambda k: F.get_json_object("o.raw_llm_metadata", f"$.duplicate_event_merge{k}")
    merge = F.when(note("").isNotNull(), F.struct(note("").alias("status"), note("_error").alias("error"), note("_count").cast("long").alias("count"), F.from_json(note("_sources"), "array<string>").alias("sources")).cast(MERGE))
    columns = {
        "outcome_index": F.col("outcome_index").cast("long"), "status": F.col("o.status"), "events": F.coalesce("o.events", F.when(F.col("o.event").isNotNull(), F.array("o.event"))),
        **{f.name: F.col(f"o.post.{f.name}") for f in POST if f.name != "post_pos"}, "errors": F.col("o.errors"), "duplicate_of_post": F.lit(None).cast("long"), "metadata": F.col("o.raw_llm_metadata"), "merge": merge,
    }
    return rows.select(*[columns[c].alias(c) for c in OUTCOME.names])


def concatenated(*sources: DataFrame) -> DataFrame:
    """Posts of several sources, one after another, with post_pos anew."""
    whole = None
    for k, posts in enumerate(sources):
        part = posts.withColumn("_source", F.lit(k))
        whole = part if whole is None else whole.unionByName(part)
    sizes = whole.groupBy("_source").agg(F.max("post_pos").alias("_most"))
    # a row for each source
    shift = sizes.withColumn("_shift", F.coalesce(F.sum(F.col("_most") + 1).over(Window.orderBy("_source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_most")
    return whole.join(F.broadcast(shift), "_source").withColumn("post_pos", F.col("post_pos") + F.col("_shift")).drop("_source", "_shift")
