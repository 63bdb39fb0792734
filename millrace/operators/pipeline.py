"""The whole run: source, guards, model, outcomes, duplicates, accumulation."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta
from functools import cached_property
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates, text
from millrace.operators import blocks, dedup, extract, guards, merge, models, refine, results, snapshot
from millrace.operators.storage import kept
from millrace.schemas import ATTEMPTS, EVENT, MERGE, POST, require


@dataclass(frozen=True)
class Settings:
    """skip_…: which guards are on. merge_event_duplicates: kept events take over what older versions say. title_model, type_model:
    names of the models that refine titles and types; none, none asked. tasks: how many ask at once (see models.answers). The
    model's name goes into metadata and into the keys of stored answers."""

    model: str = "model"
    max_errors: int | None = None
    skip_empty: bool = True
    skip_duplicates: bool = True
    skip_event_duplicates: bool = True
    merge_event_duplicates: bool = True
    retries: int = 0
    title_model: str | None = None
    type_model: str | None = None
    semantic_checks: int = 32
    tasks: int | None = None

    def __post_init__(self):
        if self.max_errors is not None and self.max_errors < 1:
            raise ValueError("max_errors must be 1 or more")
        if self.retries < 0:
            raise ValueError("retries must not be negative")


@dataclass
class Result:
    outcomes: DataFrame
    #: outcome_index, event_index, event_pos, the event's columns, group_pos, duplicate_of (null for what is kept), merge.
    events: DataFrame
    settings: Settings = Settings()

    @property
    def kept(self) -> DataFrame:
        return self.events.where("duplicate_of is null")

    @property
    def duplicates(self) -> DataFrame:
        return self.events.where("duplicate_of is not null")

    @property
    def counts(self) -> DataFrame:
        return results.status_counts(self.outcomes)

    @cached_property
    def error_limit_reached(self) -> bool:
        return not self.outcomes.where(F.exists("errors", lambda e: e["code"] == "error_limit_reached")).isEmpty()


@dataclass
class Models:
    """Makers of the models by name; "" makes the main one. stored: answers by prompt_key, taken before a model is asked."""

    main: Callable[[], object]
    others: dict[str, Callable[[], object]] = field(default_factory=dict)
    stored: DataFrame | None = None

    def ask(self, settings: Settings, name: str = "") -> refine.Ask:
        make = self.others.get(name, self.main)
        return lambda prompts, schema: models.answers(prompts, make, self.stored, settings.retries, schema, settings.tasks)


def local_now() -> str:
    """The present in the zone of the posts, three hours before UTC's midnight."""
    return (datetime.now(UTC) + timedelta(hours=3)).replace(tzinfo=None).isoformat(timespec="seconds") + "+03:00"


def numbered_events(outcomes: DataFrame) -> DataFrame:
    """outcome_index, event_index, event_pos (their order), the event's columns, prompt_text, published_ts, external_id, merge."""
    flat = results.flat_events(outcomes)
    sizes = flat.groupBy("outcome_index").agg(F.count("*").alias("_n"))
    before = guards.running_before(sizes, "_n", "outcome_index", "_before").select("outcome_index", "_before")
    own = F.col("merge") if "merge" in outcomes.columns else F.lit(None).cast(MERGE)
    posts = outcomes.select("outcome_index", F.coalesce("raw_text", "text").alias("prompt_text"), dates.published_at_utc(F.col("published_at")).alias("published_ts"), "external_id", own.alias("merge"))
    rows = flat.join(before, "outcome_index").join(posts, "outcome_index")
    return rows.select("outcome_index", "event_index", (F.col("_before") + F.col("event_index")).alias("event_pos"), "event.*", "prompt_text", "published_ts", "external_id", "merge")


SAME_PROMPT = "Two announcements follow as JSON. Say whether they announce the same event, related ones or different ones. Answer with one JSON object of the key relation: same_event, related_event or different_event."
SAME_SCHEMA = {"type": "object", "additionalProperties": False, "required": ["relation"], "properties": {"relation": {"enum": ["same_event", "related_event", "different_event"]}}}


def same_event(events: DataFrame, ask: refine.Ask, settings: Settings) -> Callable[[int, int], bool]:
    """A model's answer for two events; anything but same_event is no, a failure too."""
    shown = F.struct(
        "title", F.nullif(F.left(F.coalesce("description", F.lit("")), F.lit(3000)), F.lit("")).alias("description"), "start_at", "end_at", "city", "venue_name", "address", "event_type", "attendance_type", "source_name",
        F.array_sort(text.urls(F.col("description"), F.col("prompt_text"))).alias("urls"), F.left("prompt_text", F.lit(6000)).alias("text"),
    )

    def decide(a: int, b: int) -> bool:
        two = events.where(F.col("event_pos").isin(a, b)).agg(F.array_sort(F.collect_list(F.struct("event_pos", shown.alias("e")))).alias("x"))
        user = F.to_json(F.struct(F.col("x")[0]["e"].alias("a"), F.col("x")[1]["e"].alias("b")), {"ignoreNullFields": "false"})
        prompt = two.select(models.prompt_key(F.lit(SAME_PROMPT), user, settings.model).alias("prompt_key"), F.lit(SAME_PROMPT).alias("system"), user.alias("user"))
        answer = ask(prompt, SAME_SCHEMA).first()
        try:
            return answer.error is None and json.loads(answer.response)["relation"] == "same_event"
        except (TypeError, ValueError, KeyError, IndexError):
            return False

    return decide


def finished(outcomes: DataFrame, settings: Settings, asked: Models | None = None, semantic: bool = True) -> Result:
    """Events of the outcomes, deduplicated and merged; what merging changed is written back to the outcomes."""
    events = kept(numbered_events(outcomes))
    if not settings.skip_event_duplicates:
        return Result(outcomes, events.withColumns({"group_pos": F.col("event_pos"), "duplicate_of": F.lit(None).cast("long")}), settings)
    # one prompt at a time, so one task
    decide = same_event(events, asked.ask(replace(settings, tasks=1)), settings) if asked and semantic else None
    events = dedup.deduplicated(events, decide, settings.semantic_checks)
    if asked and settings.merge_event_duplicates:
        events = kept(merge.merged(kept(events), asked.ask(settings), settings.model))
        done = events.where("duplicate_of is null").select("outcome_index", "event_index", F.struct(*EVENT.names).alias("event"), "merge")
        outcomes = dedup.write_back(outcomes, done)
        if "merge" in outcomes.columns:
            last = done.groupBy("outcome_index").agg(F.max_by(F.struct("merge"), "event_index").alias("_last"))
            outcomes = outcomes.join(last, "outcome_index", "left").withColumn("merge", F.when(F.col("_last").isNull(), F.col("merge")).otherwise(F.col("_last.merge"))).drop("_last")
        outcomes = kept(outcomes)
    return Result(outcomes, events, settings)


def attempt(rows: DataFrame, asked: Models, settings: Settings, today: Column, now: str, stage: str) -> DataFrame:
    """rows (guarded, and errors of the answer before in a repair) asked for, parsed, expanded, refined and judged."""
    repair = stage != "main_extraction"
    system, user = F.lit(extract.system_prompt()), extract.user_prompt(F.lit(now), F.to_json("_errors") if repair else None)
    keyed = kept(rows.withColumn("_user", user).withColumn("prompt_key", models.prompt_key(system, F.col("_user"), settings.model)))
    found = asked.ask(settings)(keyed.select("prompt_key", system.alias("system"), F.col("_user").alias("user"), F.col("post_pos").alias("at")), extract.response_schema())
    df = extract.parsed(blocks.spread(keyed.join(found, "prompt_key", "left").drop("prompt_key", "_user"), "post_pos"))
    failed = F.when(F.col("problem").isin("llm_error", "daily_rate_limit_exceeded"), F.coalesce("error", F.lit("error: not a JSON object")))
    one = F.array(F.struct(F.lit(stage).alias("stage"), F.lit(settings.model).alias("model"), failed.isNull().alias("success"), failed.alias("error"))).cast(ATTEMPTS)
    df = extract.expanded(df.withColumn("attempts", F.concat("attempts", one) if repair else one), today)
    by = lambda prompts, schema: asked.ask(settings, settings.title_model if schema == refine.title_schema() else settings.type_model)(prompts, schema)
    df = refine.refined(df.drop("response", "error"), by, settings.title_model, settings.type_model)
    return kept(extract.judged(df.withColumn("stage", F.lit(stage)), today))


def metadata(settings: Settings, now: str, previous: Column | None = None) -> Column:
    """A row's record of how it came about, as JSON."""
    parts = {
        "llm_model": F.lit(settings.model), "main_model": F.lit(settings.model), "refinement_model": F.lit(settings.type_model), "active_model": F.lit(settings.model), "active_stage": F.col("stage"), "external_id": F.col("external_id"),
        "current_datetime": F.lit(now), "event_type_refinement_enabled": F.lit(settings.type_model is not None), "max_retries": F.lit(settings.retries), "llm_attempts": F.col("attempts"),
        "event_type_refinement": F.col("type_status"), "title_description_refinement": F.col("title_status"), "batch_index": F.col("batch_index"), "duplicate_of": F.col("first_pos"),
    }
    if previous is not None:
        parts["previous_llm_metadata"] = F.try_parse_json(previous)
    return F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()]))


def extract_batch(posts: DataFrame, model_of: Callable[[], object] | Models, settings: Settings = Settings(), stored: DataFrame | None = None, today: Column | None = None, now: str = "", finish: bool = True) -> Result:
    """posts (POST's columns) to outcomes and events.

    An answer with an end before its start is asked for once more, with its errors. The error budget and the daily latch come
    last, as if posts had been asked for one after another; a distributed run may have asked for more.
    """
    asked = model_of if isinstance(model_of, Models) else Models(model_of, stored=stored)
    today, now = F.current_date() if today is None else today, now or local_now()
    guarded = guards.running_before(guards.guarded(posts, today, settings.skip_empty, settings.skip_duplicates).withColumn("_one", F.lit(1)), "_one", "post_pos", "batch_index").drop("_one")
    guarded = kept(guarded)
    first = attempt(guarded.where("guard is null"), asked, settings, today, now, "main_extraction").withColumn("metadata", metadata(settings, now))
    again = F.coalesce((F.col("status") == "invalid") & extract.needs_date_repair(F.col("errors")), F.lit(False))
    columns = [*guarded.columns, "attempts"]
    repair = first.where(again).select(*columns, F.col("errors").alias("_errors"), F.col("metadata").alias("_previous"))
    second = attempt(repair, asked, settings, today, now, "invalid_date_repair").withColumn("metadata", metadata(settings, now, F.col("_previous"))).drop("_errors", "_previous")
    none = lambda kind: F.lit(None).cast(kind)
    skipped = extract.judged(guarded.where("guard is not null").withColumns({"payloads": none(first.schema["payloads"].dataType), "problem": none("string"), "skip_reason": none("string")}), today)
    skipped = skipped.withColumn("metadata", F.to_json(F.struct("batch_index", F.col("first_pos").alias("duplicate_of"))))
    rows = first.where(~again).unionByName(second, allowMissingColumns=True).unionByName(skipped, allowMissingColumns=True)
    outcomes = kept(extract.limited(rows, settings.max_errors))
    return finished(outcomes, settings, asked) if finish else Result(outcomes, outcomes.limit(0), settings)


def extract_incremental(
    posts: DataFrame, existing: DataFrame, model_of: Callable[[], object] | Models, settings: Settings = Settings(), stored: DataFrame | None = None, today: Column | None = None, now: str = "", accumulate: bool = False, prune: bool = False,
    retry_llm_errors: bool = True, source_errors: DataFrame | None = None,
) -> Result:
    """As extract_batch, but posts whose outcome is known are not asked for again. accumulate keeps outcomes of other posts; it is
    forced if the source had errors, as posts may be missing then. retry_llm_errors: whether failed outcomes are asked for anew.
    Guards, budget and latch concern the posts that are asked for."""
    asked = model_of if isinstance(model_of, Models) else Models(model_of, stored=stored)
    matched = kept(snapshot.matched(posts, existing, retry_llm_errors))
    fresh = extract_batch(matched.where("cached is null").drop("cached"), asked, settings, today=today, now=now, finish=False).outcomes.withColumn("cached", F.lit(False))
    names = [c for c in fresh.columns if c not in ("outcome_index", "cached", *posts.columns)]
    known = matched.where("cached is not null").select(
        F.col("post_pos").alias("outcome_index"), *[F.col(f"cached.{c}").alias(c) for c in names if c in existing.columns], *[c for c in posts.columns if c != "post_pos"], F.lit(True).alias("cached")
    )
    outcomes = fresh.unionByName(known, allowMissingColumns=True)
    accumulate = accumulate or (source_errors is not None and not source_errors.isEmpty())
    if accumulate:
        outcomes = snapshot.accumulated(kept(outcomes), existing, prune)
    return finished(kept(outcomes), settings, asked)


class Source(Protocol):
    """Where posts come from. cached_ids: external_id of posts known already, or null. Gives posts (POST's columns) and errors."""

    def posts(self, cached_ids: DataFrame | None) -> tuple[DataFrame, DataFrame | None]: ...


@dataclass
class Pipeline:
    """A source, models and settings for repeated runs. Arguments of run() come before what is configured, and outcomes before a
    path to them: run's outcomes, configured outcomes, run's path, configured path, none."""

    source: Source
    models: Models
    settings: Settings = Settings()
    existing: DataFrame | None = None
    previous_path: str | None = None
    save_path: str | None = None
    accumulate: bool = False
    prune: bool = True
    retry_llm_errors: bool = True

    def resolved(self, spark, existing: DataFrame | None = None, previous_path: str | None = None) -> DataFrame | None:
        from millrace.sources import posts as files

        for known in (existing, self.existing):
            if known is not None:
                return known
        path = previous_path if previous_path is not None else self.previous_path
        if path is None:
            return None
        return files.load_json(spark, path) if path.endswith(".json") else files.load_snapshot(spark, path)

    def run(self, spark, existing: DataFrame | None = None, previous_path: str | None = None, save_path: str | None = None, accumulate: bool | None = None, today: Column | None = None, now: str = "") -> Result:
        from millrace.sources import posts as files

        known = self.resolved(spark, existing, previous_path)
        posts, errors = self.source.posts(None if known is None else snapshot.cached_ids(known))
        require(posts, POST)
        posts = kept(posts)
        if known is None:
            result = extract_batch(posts, self.models, self.settings, today=today, now=now)
        else:
            keep = self.accumulate if accumulate is None else accumulate
            result = extract_incremental(posts, known, self.models, self.settings, today=today, now=now, accumulate=keep, prune=self.prune, retry_llm_errors=self.retry_llm_errors, source_errors=errors)
        path = save_path if save_path is not None else self.save_path
        if path is not None:
            files.save_json(result.outcomes, path) if path.endswith(".json") else files.save_snapshot(result.outcomes, path)
        return result
