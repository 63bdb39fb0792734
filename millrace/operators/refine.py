"""A model's further steps on the events of an answer: titles and descriptions, and event types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import blocks, models
from millrace.operators.storage import kept
from millrace.schemas import EVENT_TYPES, PAYLOAD

#: Takes prompts (prompt_key, system, user) and a schema; gives prompt_key, response, error.
Ask = Callable[[DataFrame, dict], DataFrame]

TITLE_STEP, TYPE_STEP = "title_description_refinement", "event_type_refinement"
TITLE_PROMPT = "Name the event that a post announces, in its own words where it has a name, and describe it in full and without advertising. Answer with one JSON object of the keys title and description (null if there is nothing to say)."
TYPE_PROMPT = "Choose the type of the event that a post announces, the closest of the list; SocialEvent only if no other fits. Answer with one JSON object of the key event_type. The list: " + ", ".join(EVENT_TYPES)


def title_schema() -> dict:
    return {"type": "object", "additionalProperties": False, "required": ["title", "description"], "properties": {"title": {"type": "string"}, "description": {"type": ["string", "null"]}}}


def type_schema() -> dict:
    return {"type": "object", "additionalProperties": False, "required": ["event_type"], "properties": {"event_type": {"enum": list(EVENT_TYPES)}}}


def is_object(response: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(response)).startswith("OBJECT"), F.lit(False))


def kind_at(response: Column, path: str) -> Column:
    """The JSON type at a path; null if there is none."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(response), path, "variant"))


def string_at(response: Column, path: str) -> Column:
    """The value at a path if it is a string, else null."""
    return F.when(kind_at(response, path) == "STRING", F.try_variant_get(F.try_parse_json(response), path, "string"))


def _asked(rows: DataFrame, ask: Ask, schema: dict, stage: str, model: str, system: str, wanted: Column) -> DataFrame:
    """rows (…, p, prompt_text, attempts) with response and failed, where wanted; attempts has one more there."""
    user = F.to_json(F.struct(F.col("p").alias("draft"), F.col("prompt_text").alias("text")), {"ignoreNullFields": "false"})
    keyed = kept(rows.withColumn("_user", user).withColumn("prompt_key", F.when(wanted, models.prompt_key(F.lit(system), F.col("_user"), model))))
    found = ask(keyed.where("prompt_key is not null").select("prompt_key", F.lit(system).alias("system"), F.col("_user").alias("user"), F.col("post_pos").alias("at")), schema)
    joined = blocks.spread(keyed.join(found, "prompt_key", "left"), "post_pos")
    wrong = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("prompt_key").isNotNull() & ~is_object(F.col("response")), "error: not a JSON object")
    joined = joined.withColumn("failed", wrong)
    one = F.array(F.struct(F.lit(stage).alias("stage"), F.lit(model).alias("model"), F.col("failed").isNull().alias("success"), F.col("failed").alias("error")))
    joined = joined.withColumn("attempts", F.when(F.col("prompt_key").isNull(), F.col("attempts")).otherwise(F.concat("attempts", one)))
    return joined.withColumn("daily", F.col("daily") | F.coalesce(F.col("error") == "daily_limit", F.lit(False))).drop("_user", "error")


def title_step(rows: DataFrame, ask: Ask, model: str) -> DataFrame:
    """A refined title counts if it isn't blank and the text supports it. The answer's description counts in any case, and one that
    is left out or null takes the old one away."""
    own = F.when(text.is_missing(F.col("p.title")), text.infer_title(F.col("prompt_text"))).otherwise(text.strip(F.col("p.title")))
    rows = _asked(rows.withColumn("p", F.col("p").withField("title", own)), ask, title_schema(), TITLE_STEP, model, TITLE_PROMPT, ~F.col("daily"))
    # columns of their own, as what is named several times in one expression is computed as often
    rows = rows.withColumns({"_said": string_at(F.col("response"), "$.title"), "_kind": F.coalesce(kind_at(F.col("response"), "$.description"), F.lit("VOID"))})
    rows = rows.withColumns({"_title": text.strip(F.col("_said")), "_about": F.when(F.col("_kind") == "STRING", text.strip(F.try_variant_get(F.try_parse_json("response"), "$.description", "string")))})
    rows = rows.withColumns({"_title": F.nullif("_title", F.lit("")), "_tokens": text.tokens(F.col("_title")), "_words": text.tokens(F.col("prompt_text"))})
    rows = rows.withColumn("_good", F.coalesce(F.col("_title").isNotNull() & text.tokens_supported(F.col("_tokens"), F.col("_words")), F.lit(False)))
    title, kind, good = F.col("_title"), F.col("_kind"), F.col("_good")
    new = F.col("p").withField("title", F.when(good, title).otherwise(F.col("p.title")))
    new = new.withField("description", F.when(kind == "VOID", F.lit(None).cast("string")).when(kind == "STRING", F.col("_about")).otherwise(F.col("p.description")))
    done = F.col("prompt_key").isNotNull() & F.col("failed").isNull()
    status = F.when(F.col("failed").isNotNull(), "failed").when(done & good, "completed").when(done, "rejected")
    return rows.withColumns({"title_status": status, "p": F.when(done, new).otherwise(F.col("p"))}).drop("prompt_key", "response", "failed", "_said", "_kind", "_title", "_about", "_tokens", "_words", "_good")


def type_step(rows: DataFrame, ask: Ask, model: str) -> DataFrame:
    """Asked for where the type is none of the list, or SocialEvent. A bad answer leaves a listed type and makes another SocialEvent."""
    old = F.col("p.event_type")
    listed = F.coalesce(old.isin(*EVENT_TYPES), F.lit(False))
    rows = _asked(rows.withColumn("_listed", listed), ask, type_schema(), TYPE_STEP, model, TYPE_PROMPT, ~F.col("daily") & (~listed | (old == "SocialEvent")))
    new = string_at(F.col("response"), "$.event_type")
    good = F.coalesce(new.isin(*EVENT_TYPES), F.lit(False)) & F.col("failed").isNull()
    asked = F.col("prompt_key").isNotNull()
    kind = F.when(asked & good, new).when(asked & ~F.col("_listed"), "SocialEvent").otherwise(F.col("p.event_type"))
    status = F.when(~asked, "not_needed").when(good, "completed").when(F.col("failed").isNull() & ~F.col("_listed"), "defaulted")
    return rows.withColumns({"type_status": status, "p": F.col("p").withField("event_type", kind)}).drop("prompt_key", "response", "failed", "_listed")


def refined(df: DataFrame, ask: Ask, title_model: str | None, type_model: str | None) -> DataFrame:
    """df (post_pos, prompt_text, payloads, problem, attempts) after the steps; title_status and type_status are those of the last
    event. A daily limit in a step makes the post's problem."""
    if title_model is None and type_model is None:
        return df.withColumns({"title_status": F.lit("disabled"), "type_status": F.lit("disabled")})
    df = kept(df)
    rows = df.select("post_pos", "prompt_text", F.posexplode("payloads").alias("k", "p"))
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"daily": F.lit(False), "attempts": F.array().cast(df.schema["attempts"].dataType), "title_status": F.lit("disabled"), "type_status": F.lit("disabled")})
    if title_model is not None:
        rows = title_step(rows, ask, title_model)
    if type_model is not None:
        rows = type_step(rows, ask, type_model)
    in_order = F.array_sort(F.collect_list(F.struct("k", F.col("p").cast(PAYLOAD).alias("p"), "attempts", "title_status", "type_status")))
    back = rows.groupBy("post_pos").agg(in_order.alias("_all"), F.max("daily").alias("_daily"))
    last = lambda c: F.when(F.size("_all") > 0, F.element_at("_all", -1)[c]).otherwise(none)
    joined = df.join(back, "post_pos", "left")
    return joined.withColumns(
        {
            "payloads": F.when(F.col("_all").isNotNull(), F.transform("_all", lambda x: x["p"])).otherwise(F.col("payloads")),
            "attempts": F.concat("attempts", F.coalesce(F.flatten(F.transform("_all", lambda x: x["attempts"])), F.array().cast(df.schema["attempts"].dataType))),
            "problem": F.when(F.coalesce("_daily", F.lit(False)), "daily_rate_limit_exceeded").otherwise(F.col("problem")), "title_status": last("title_status"), "type_status": last("type_status"),
        }
    ).drop("_all", "_daily")
