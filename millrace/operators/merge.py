"""The kept event of a group takes over what older versions say, by a model; and what it has taken over is remembered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text
from millrace.operators import models
from millrace.operators.refine import Ask, is_object, kind_at
from millrace.operators.storage import kept
from millrace.schemas import EVENT, INDUSTRIES, MERGE, ROLES

#: The fields that may be taken over; facts such as dates, places and prices are the latest version's alone.
FIELDS = ("description", "relevant_roles", "industries", "skills", "target_audience_text")
LISTS = ("relevant_roles", "industries", "skills")
PROMPT = (
    "Several versions of one event are given; fresh is the latest and the only source of dates, places and prices. Add to it what "
    "earlier versions say beyond that and it doesn't contradict: programme, topics, audience, links that still hold. Answer with one "
    "JSON object of exactly the keys description, relevant_roles, industries, skills, target_audience_text; null where no version says anything."
)
_PREVIOUS = T.StructType([f for f in EVENT if f.name in FIELDS])


def merge_schema() -> dict:
    string = {"type": ["string", "null"]}
    listed = lambda domain: {"type": ["array", "null"], "items": {"type": "string", **({"enum": list(domain)} if domain else {})}}
    fields = {"description": string, "relevant_roles": listed(ROLES), "industries": listed(INDUSTRIES), "skills": listed(()), "target_audience_text": string}
    return {"type": "object", "additionalProperties": False, "required": list(FIELDS), "properties": fields}


def unmerged(previous: Column, covered: Column) -> Column:
    """Of earlier versions (structs at, pos, key, sources, fields), the latest first, those whose source isn't covered yet; each
    taken covers itself and all it has taken over itself. A struct of selected and covered."""
    kind = T.StructType().add("selected", T.ArrayType(_PREVIOUS)).add("covered", T.ArrayType(T.StringType()))
    start = F.struct(F.array().cast(kind["selected"].dataType).alias("selected"), covered.alias("covered")).cast(kind)

    def take(acc: Column, x: Column) -> Column:
        new = F.struct(F.concat(acc["selected"], F.array(x["fields"])).alias("selected"), F.array_distinct(F.concat(acc["covered"], F.array(x["key"]), x["sources"])).alias("covered"))
        return F.when(F.array_contains(acc["covered"], x["key"]), acc).otherwise(new).cast(kind)

    return F.aggregate(F.array_sort(previous), start, take)


def merged(events: DataFrame, ask: Ask, model: str) -> DataFrame:
    """events (after deduplicated(), with external_id and merge) whose kept rows have the fields and merge of the model's answer.

    A null never erases what is there, an incomplete answer is partial and leaves no sources, and a failed one changes nothing.
    Groups without anything new are not asked for.
    """
    key = text.merge_source_key(F.col("external_id"), F.col("prompt_text"))
    sources = F.coalesce("merge.sources", F.array().cast("array<string>"))
    # the latest first, those without time last, equals in their order
    at = F.coalesce(-F.unix_micros("published_ts"), F.lit(2**62))
    fields = F.struct(*[F.col(c) for c in FIELDS])
    old = events.where("duplicate_of is not null").select(F.col("duplicate_of").alias("event_pos"), F.struct(at.alias("at"), F.col("event_pos").alias("pos"), key.alias("key"), sources.alias("sources"), fields.alias("fields")).alias("v"))
    # of one source only the latest version can be taken, so a group's copies of a post don't meet
    old = old.groupBy("event_pos", F.col("v.key").alias("_key")).agg(F.min("v").alias("v")).groupBy("event_pos").agg(F.collect_list("v").alias("_previous"))
    rows = events.join(old, "event_pos", "left")
    rows = rows.withColumn("_take", F.when(F.col("_previous").isNotNull(), unmerged(F.col("_previous"), sources))).drop("_previous")
    fresh = F.struct(*[F.col(c) for c in EVENT.names])
    options = {"ignoreNullFields": "false"}
    user = F.to_json(F.struct(fresh.alias("fresh"), F.col("_take.selected").alias("previous")), options)
    asked = F.coalesce(F.size("_take.selected") > 0, F.lit(False))
    rows = rows.withColumn("_user", F.when(asked, user)).withColumn("prompt_key", F.when(asked, models.prompt_key(F.lit(PROMPT), user, model)))
    rows = kept(rows)
    found = ask(rows.where("prompt_key is not null").select("prompt_key", F.lit(PROMPT).alias("system"), F.col("_user").alias("user")), merge_schema())
    rows = rows.join(found, "prompt_key", "left")
    response, asked = F.col("response"), F.col("prompt_key").isNotNull()
    there = {c: kind_at(response, f"$.{c}") for c in FIELDS}
    fits = {c: there[c].isNull() | (there[c] == "VOID") | ((there[c].startswith("ARRAY<STRING>") | (there[c] == "ARRAY<VOID>")) if c in LISTS else there[c] == "STRING") for c in FIELDS}
    good = F.lit(True)
    for c in FIELDS:
        good = good & fits[c]
    wrong = F.when(F.col("error").isNotNull(), F.col("error")).when(asked & ~is_object(response), "error: not a JSON object").when(asked & ~good, "error: a field of another type")
    rows = rows.withColumn("_wrong", wrong)
    value = lambda c: F.try_variant_get(F.try_parse_json(response), f"$.{c}", EVENT[c].dataType.simpleString())
    done = asked & F.col("_wrong").isNull()
    names = F.json_object_keys("response")
    complete = F.forall(F.array(*map(F.lit, FIELDS)), lambda c: F.array_contains(names, c))
    what = F.when(F.col("_wrong").isNotNull(), "failed").when(complete, "completed").otherwise("partial")
    sources = F.when(done & complete, F.array_sort("_take.covered")).otherwise(F.col("merge.sources"))
    new = F.struct(what.alias("status"), F.col("_wrong").alias("error"), F.when(done, F.size("_take.selected").cast("long")).alias("count"), sources.alias("sources")).cast(MERGE)
    rows = rows.withColumns({c: F.when(done, F.coalesce(value(c), F.col(c))).otherwise(F.col(c)) for c in FIELDS} | {"merge": F.when(asked, new).otherwise(F.col("merge"))})
    return rows.drop("_take", "_user", "_wrong", "prompt_key", "response", "error")
