"""From posts and model answers to outcomes: parse, expand, repair, validate."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import dates, rules, text
from millrace.operators import blocks
from millrace.operators.guards import eligible, with_limits
from millrace.operators.storage import kept
from millrace.schemas import ATTENDANCE_TYPES, EVENT, EVENT_TYPES, INDUSTRIES, MERGE, PAYLOAD, ROLES, SKIP_REASONS

RESPONSE = T.StructType([T.StructField("is_event", T.StringType()), T.StructField("skip_reason", T.StringType()), T.StructField("event", PAYLOAD), T.StructField("events", T.ArrayType(PAYLOAD))])


def payload_schema() -> dict:
    """The JSON schema of an event in an answer: closed, every field there, null where unknown."""
    string = {"type": ["string", "null"]}
    listed = lambda domain: {"type": ["array", "null"], "items": {"type": "string", **({"enum": list(domain)} if domain else {})}}
    own = {"title": {"type": "string"}, "event_type": {"enum": list(EVENT_TYPES)}, "attendance_type": {"enum": [*ATTENDANCE_TYPES, "unknown"]}}
    own |= {"relevant_roles": listed(ROLES), "industries": listed(INDUSTRIES), "skills": listed(())}
    fields = {f.name: own.get(f.name, string) for f in EVENT if f.name not in ("raw_text", "source_name", "source_url")}
    return {"type": "object", "additionalProperties": False, "required": list(fields), "properties": fields}


def response_schema() -> dict:
    event = payload_schema()
    fields = {"is_event": {"type": "boolean"}, "skip_reason": {"enum": [*SKIP_REASONS, None]}, "event": {"anyOf": [event, {"type": "null"}]}, "events": {"anyOf": [{"type": "array", "items": event}, {"type": "null"}]}}
    return {"type": "object", "additionalProperties": False, "required": list(fields), "properties": fields}


def system_prompt() -> str:
    return "Find announced events in a post. Answer with one JSON object of this schema, with local times and no time zone offsets:\n" + json.dumps(response_schema(), separators=(",", ":"))


def user_prompt(now: Column, errors: Column | None = None) -> Column:
    """The post as compact JSON, and for a repair the errors of the answer before."""
    parts = {"current_datetime": now, "published_at": F.col("published_at"), "source_name": F.col("source_name"), "text": F.col("prompt_text")}
    if errors is not None:
        parts["errors"] = errors
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))


def parsed(answered: DataFrame) -> DataFrame:
    """answered (response, error) with payloads (an array), skip_reason, and problem: why there are no payloads, or null.

    A list of events counts before a single one. Only the JSON value false for is_event skips a post.
    """
    tree = F.try_parse_json("response")
    fits = F.coalesce(F.schema_of_variant(tree).startswith("OBJECT"), F.lit(False))
    no = F.get_json_object("response", "$.is_event") == "false"
    no = no & ~F.coalesce(F.regexp_like("response", F.lit(r'"is_event"\s*:\s*"')), F.lit(False))
    body = F.from_json(F.when(fits, F.col("response")), RESPONSE)
    df = answered.withColumn("_fits", fits).withColumn("_no", F.coalesce(no, F.lit(False))).withColumn("_body", body)
    several = F.filter("_body.events", lambda x: x.isNotNull())
    payloads = F.when(F.size(several) > 0, several).when(F.col("_body.event").isNotNull(), F.array("_body.event"))
    reason = F.when(F.col("_body.skip_reason").isin(*SKIP_REASONS), F.col("_body.skip_reason")).otherwise("not_event_announcement")
    df = df.withColumn("skip_reason", F.when(F.col("_fits") & F.col("_no"), reason)).withColumn("payloads", F.when(F.col("skip_reason").isNull(), payloads))
    problem = (
        F.when(F.col("error") == "daily_limit", "daily_rate_limit_exceeded")
        .when(F.col("error").isNotNull() | ~F.col("_fits"), "llm_error")
        .when(F.col("skip_reason").isNull() & F.col("payloads").isNull(), "invalid_llm_shape")
    )
    return df.withColumn("problem", problem).drop("_fits", "_no", "_body")


def expanded(df: DataFrame, today: Column) -> DataFrame:
    """A single payload whose text lists several starts becomes one for each, without an end."""
    starts = dates.listed_starts(F.col("prompt_text"), dates.published_date(F.col("published_at")), today)
    one = F.col("payloads")[0]
    clone = F.transform("_starts", lambda s: one.withField("start_at", F.date_format(s, "yyyy-MM-dd'T'HH:mm:ss")).withField("end_at", F.lit(None).cast("string")))
    df = df.withColumn("_starts", starts)
    return df.withColumn("payloads", F.when((F.size("payloads") == 1) & (F.size("_starts") >= 2), clone).otherwise(F.col("payloads"))).drop("_starts")


def judged(df: DataFrame, today: Column) -> DataFrame:
    """df (of parsed() and expanded()) with events, errors, status and is_daily_limit, row by row.

    One invalid event makes its post invalid, and its events are then left out.
    """
    published, raw = dates.published_date(F.col("published_at")), F.col("prompt_text")

    def event(p: Column, d: Column) -> Column:
        columns = rules.repaired(p) | {"start_at": d["start_at"], "end_at": d["end_at"], "raw_text": raw, "source_name": F.col("source_name"), "source_url": F.col("source_url")}
        return F.struct(*[columns[f.name].cast(f.dataType).alias(f.name) for f in EVENT])

    df = df.withColumns(rules.text_facts(raw, published, today))
    made = lambda p: F.struct(p.alias("p"), dates.let(rules.repaired_dates(p, raw), lambda d: event(p, d)).alias("e"))
    df = df.withColumn("_made", F.transform("payloads", made))
    df = df.withColumn("_found", F.transform("_made", lambda x: rules.errors_of(x["p"], x["e"])))
    several = F.size("_made") > 1
    prefixed = F.flatten(F.transform("_found", lambda es, k: F.transform(es, lambda e: e.withField("field", F.when(several, F.concat(F.lit("events."), k.cast("string"), F.lit("."), e["field"])).otherwise(e["field"])))))
    issue = lambda field, code: F.array(F.struct(F.lit(field).alias("field"), code.alias("code"), code.alias("message")))
    guard, problem = F.col("guard"), F.col("problem")
    field = F.when(guard == "empty_post", "post.text").when(guard == "duplicate_post", "post").otherwise("root")
    errors = (
        F.when(guard.isNotNull(), F.array(F.struct(field.alias("field"), guard.alias("code"), guard.alias("message"))))
        .when(problem == "invalid_llm_shape", issue("event", problem)).when(problem.isNotNull(), issue("llm", problem))
        .when(F.col("skip_reason").isNotNull(), issue("root", F.col("skip_reason"))).otherwise(prefixed)
    )
    df = df.withColumn("errors", errors)
    status = F.when(guard.isNotNull() | F.col("skip_reason").isNotNull(), "skipped").when(problem.isNotNull(), "llm_error").when(F.size("errors") > 0, "invalid").otherwise("extracted")
    df = df.withColumn("status", status).withColumn("is_daily_limit", F.coalesce(problem == "daily_rate_limit_exceeded", F.lit(False)))
    return df.withColumn("events", F.when(F.col("status") == "extracted", F.transform("_made", lambda x: x["e"]))).drop("_made", "_found", *rules.text_facts(raw, published, today))


def limited(df: DataFrame, max_errors: int | None = None) -> DataFrame:
    """Outcome rows of judged ones, after the error budget and the daily latch. metadata may be missing."""
    df = with_limits(df.withColumn("eligible", eligible(F.col("guard"))), max_errors, "post_pos")
    hit = F.col("limit").isNotNull()
    field = F.when(F.col("limit") == "error_limit_reached", "batch").otherwise("llm")
    errors = F.when(hit, F.array(F.struct(field.alias("field"), F.col("limit").alias("code"), F.col("limit").alias("message")))).otherwise(F.col("errors"))
    df = df.withColumns({"errors": errors, "events": F.when(F.col("status") == "extracted", F.col("events"))})
    if "metadata" in df.columns:
        # what a row got from a model that a run in order would not have asked is none of its own
        df = df.withColumn("metadata", F.when(hit & ~F.coalesce(F.col("is_daily_limit"), F.lit(False)), F.to_json(F.struct("batch_index"))).otherwise(F.col("metadata")))
    columns = [c for c in ("text", "raw_text", "source_name", "source_url", "published_at", "external_id", "is_pinned") if c in df.columns]
    more = [F.col("metadata"), F.lit(None).cast(MERGE).alias("merge")] if "metadata" in df.columns else []
    return df.select(F.col("post_pos").alias("outcome_index"), "status", "events", *columns, "errors", F.col("first_pos").alias("duplicate_of_post"), *more)


def outcomes(answered: DataFrame, today: Column | None = None, max_errors: int | None = None) -> DataFrame:
    """outcome_index, status, events, post columns, errors of each post (post_pos, the post's columns, prompt_text, guard, first_pos,
    response, error), without the model's further steps."""
    today = F.current_date() if today is None else today
    # written, as the daily latch is looked up first and would judge all rows once more
    return limited(kept(judged(expanded(parsed(blocks.spread(answered, "post_pos")), today), today)), max_errors)


def validated(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """payloads (JSON texts) with errors: what is wrong with each as an event on its own. Here unknown fields count, as they are
    dropped only on the way from a model's answer."""
    tree = F.try_parse_json(column)
    is_object = F.coalesce(F.schema_of_variant(tree).startswith("OBJECT"), F.lit(False))
    issue = lambda field, code, message: F.struct(field.alias("field"), F.lit(code).alias("code"), F.lit(message).alias("message"))
    df = payloads.withColumn("_p", F.from_json(F.when(is_object, F.col(column)), PAYLOAD)).withColumn("_keys", F.when(is_object, F.json_object_keys(column)))
    odd = F.transform(F.filter("_keys", lambda k: ~k.isin(*PAYLOAD.names)), lambda k: issue(k, "unexpected_field", "unexpected field"))
    dated = F.struct(*[(dates.local_time(F.col("_p")[c]) if c in ("start_at", "end_at") else F.col("_p")[c]).alias(c) for c in PAYLOAD.names])
    blank = lambda c: F.coalesce(text.strip(F.col("_p")[c]), F.lit("")) == ""
    missing = F.array_compact(F.array(*[F.when(blank(c), issue(F.lit(c), "invalid_field", "must not be blank")) for c in ("title", "language", "timezone", "raw_text")]))
    found = F.concat(odd, missing, rules.errors_of(F.col("_p"), dated))
    none = F.array(issue(F.lit("root"), "invalid_type", "not an object"))
    return df.withColumn("errors", F.when(is_object, found).otherwise(none)).drop("_p", "_keys")


def needs_date_repair(errors: Column) -> Column:
    """Whether an answer is asked for once more, with its errors."""
    return F.exists(errors, lambda e: (e["code"] == "invalid_field") & e["field"].endswith("end_at") & (e["message"] == "end_at must not be before start_at"))
