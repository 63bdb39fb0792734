"""The model's further steps: date repair, refinement, semantic duplicates, merging; and repeated runs of a pipeline."""

import json
from datetime import datetime

import pytest
from millrace.operators import extract, merge, models, pipeline, refine, results, snapshot
from millrace.schemas import POST
from millrace.sources import posts as post_files
from millrace.sources import wall
from millrace.streaming import incremental
from pyspark.sql import functions as F


def today():
    return F.lit("2026-06-01").cast("date")


def posts(spark, *rows):
    """Texts, or (text, id, published)."""
    rows = [(r, f"vk:wall-1_{k}", "2026-06-01T10:00:00") if isinstance(r, str) else r for k, r in enumerate(rows)]
    return spark.createDataFrame([(k, t, None, None, None, at, i, False) for k, (t, i, at) in enumerate(rows)], POST)


class Steps:
    """A model whose answers come from functions of the prompt, by step."""

    def __init__(self, **answers):
        self.answers = answers

    def complete(self, system, user):
        asked = json.loads(user)
        kind = {refine.TITLE_PROMPT: "title", refine.TYPE_PROMPT: "type", merge.PROMPT: "merge", pipeline.SAME_PROMPT: "same"}.get(system, "repair" if "errors" in asked else "main")
        if kind not in self.answers:
            raise RuntimeError(f"no answer to {kind}")
        out = self.answers[kind](asked)
        if out == "daily":
            raise models.ModelError("limit", daily=True)
        return out if isinstance(out, str) else json.dumps(out)


def event(**columns):
    return {"is_event": True, "event": {"title": "Лекция о звездах", "event_type": "EducationEvent", **columns}}


def run(spark, given, model, **settings):
    return pipeline.extract_batch(posts(spark, *given), pipeline.Models(lambda: model), pipeline.Settings(**settings), today=today(), now="2026-06-01T12:00:00")


def test_an_end_before_the_start_is_asked_for_once_more(spark):
    ends = {"one": "2026-06-05T20:00", "two": "2026-06-03T20:00"}
    seen = []

    def repaired(asked):
        word = asked["text"].split()[0]
        assert "end_at must not be before start_at" in asked["errors"]
        return "daily" if word == "three" else event(start_at="2026-06-05T18:00", end_at=ends[word])

    model = Steps(main=lambda asked: event(start_at="2026-06-05T18:00", end_at="2026-06-04T18:00"), repair=repaired)
    got = run(spark, ["one", "two", "three"], model).outcomes.orderBy("outcome_index").collect()
    assert [r.status for r in got] == ["extracted", "invalid", "llm_error"] and got[0].events[0].end_at == datetime(2026, 6, 5, 20)
    notes = [json.loads(r.metadata) for r in got]
    assert [x["stage"] for x in notes[0]["llm_attempts"]] == ["main_extraction", "invalid_date_repair"] and notes[0]["active_stage"] == "invalid_date_repair"
    assert notes[0]["previous_llm_metadata"]["active_stage"] == "main_extraction" and [n["batch_index"] for n in notes] == [0, 1, 2]
    assert got[2].errors[0].code == "daily_rate_limit_exceeded" and not seen


def test_titles_and_types_are_refined(spark):
    kinds = {"конкурс": "SocialEvent", "хакатон": "made up", "лекция": "EducationEvent", "ошибка": "made up", "сбой": "SocialEvent"}
    word = lambda asked: asked["text"].split()[0]
    new = {"конкурс": "CompetitionEvent", "хакатон": "no such type", "ошибка": 5, "лекция": "Festival"}

    def typed(asked):
        if word(asked) == "сбой":
            raise RuntimeError("down")
        return {"event_type": new[word(asked)]}

    def titled(asked):
        return {"конкурс": {"title": " Конкурс чтецов ", "description": " Чтение "}, "хакатон": {"title": "Нечто совсем иное"}, "лекция": {"title": 5, "description": 7}, "ошибка": "garbage", "сбой": {"title": "Конкурс", "description": None}}[word(asked)]

    model = Steps(main=lambda asked: event(event_type=kinds[word(asked)], description="old", start_at="2026-06-05T18:00"), title=titled, type=typed)
    got = run(spark, [f"{w} чтецов" for w in kinds], model, title_model="t", type_model="k", skip_event_duplicates=False).outcomes.orderBy("outcome_index").collect()
    assert [(r.events[0].title, r.events[0].description, r.events[0].event_type) for r in got] == [
        ("Конкурс чтецов", "Чтение", "CompetitionEvent"), ("Лекция о звездах", None, "SocialEvent"), ("Лекция о звездах", "old", "EducationEvent"), ("Лекция о звездах", "old", "SocialEvent"), ("Лекция о звездах", None, "SocialEvent"),
    ]
    notes = [json.loads(r.metadata) for r in got]
    assert [n["title_description_refinement"] for n in notes] == ["completed", "rejected", "rejected", "failed", "rejected"]
    assert [n.get("event_type_refinement") for n in notes] == ["completed", "defaulted", "not_needed", "defaulted", None]
    assert [x["stage"] for x in notes[0]["llm_attempts"]] == ["main_extraction", refine.TITLE_STEP, refine.TYPE_STEP]
    daily = Steps(main=lambda asked: event(start_at="2026-06-05T18:00"), title=lambda asked: "daily")
    assert [r.status for r in run(spark, ["a", "b"], daily, title_model="t").outcomes.collect()] == ["llm_error"] * 2


def test_a_model_joins_what_titles_dont(spark):
    titles = {"a": "Ночь музеев", "b": "Экскурсия по залам", "c": "Забег"}
    word = lambda asked: asked["text"].split()[-1]
    asked_for = []

    def same(asked):
        assert asked["a"]["urls"] == asked["b"]["urls"] == ["https://tickets.example/show?event=42"]
        return {"relation": "same_event"}

    model = Steps(main=lambda asked: event(title=titles[word(asked)], start_at="2026-06-05T18:00"), same=same)
    link = "вход http://Tickets.example/show/?event=42&utm_source=x в зал и парк"
    got = run(spark, [f"{link} a", f"{link} b", "c"], model, merge_event_duplicates=False)
    assert [(r.event_pos, r.duplicate_of) for r in got.events.orderBy("event_pos").collect()] == [(0, 1), (1, None), (2, None)] and not asked_for
    off = run(spark, [f"{link} a", f"{link} b", "c"], model, merge_event_duplicates=False, semantic_checks=0)
    assert off.duplicates.isEmpty()


def version(asked):
    old = "old" in asked["text"]
    return event(title="Фестиваль света", start_at="2026-07-10T20:00" if not old else "2026-07-10T19:00", description="Программа и билеты https://t.example" if old else None, skills=["свет"] if old else None, venue_name="Зал" if old else "Новый зал")


def test_kept_events_take_over_what_older_ones_say(spark):
    given = [("old", "vk:wall-1_1", "2026-07-01T10:00:00"), ("new", "vk:wall-1_2", "2026-07-07T10:00:00"), ("old old", "vk:wall-1_3", "2026-06-01T10:00:00")]
    full = {"description": "Все вместе", "relevant_roles": ["Guest"], "industries": None, "skills": None, "target_audience_text": "все"}
    seen = []

    def merged(asked):
        assert asked["fresh"]["venue_name"] == "Новый зал" and [set(p) for p in asked["previous"]] == [set(merge.FIELDS)] * len(asked["previous"])
        return full

    got = run(spark, given, Steps(main=version, merge=merged))
    (r,) = got.kept.collect()
    assert (r.description, r.relevant_roles, r.venue_name, r.start_at, r.target_audience_text) == ("Все вместе", ["Guest"], "Новый зал", datetime(2026, 7, 10, 20), "все")
    assert (r.merge.status, r["merge"]["count"], r.merge.sources) == ("completed", 2, ["vk:wall-1_1", "vk:wall-1_3"]) and got.duplicates.count() == 2 and not seen
    written = got.outcomes.where("outcome_index = 1").first()
    assert written.events[0].description == "Все вместе" and written.merge.sources == r.merge.sources
    # what is covered isn't asked for again
    again = pipeline.extract_incremental(posts(spark, *given), got.outcomes, pipeline.Models(lambda: Steps()), today=today())
    assert again.kept.first().description == "Все вместе" and again.kept.first().merge.status == "completed"


@pytest.mark.parametrize("answer,status", [({"description": "часть", "skills": None}, "partial"), ("not-json", "failed"), ({"description": 5, "relevant_roles": None, "industries": None, "skills": None, "target_audience_text": None}, "failed")])
def test_incomplete_and_failed_merges(spark, answer, status):
    given = [("old", "vk:wall-1_1", "2026-07-01T10:00:00"), ("new", "vk:wall-1_2", "2026-07-07T10:00:00")]
    r = run(spark, given, Steps(main=version, merge=lambda asked: answer)).kept.first()
    assert (r.description, r.merge.status, r.merge.sources) == ("часть" if status == "partial" else None, status, None)


def test_lineage(spark):
    """The latest first; what is covered, or has the same source as one taken, is left out."""
    fields = "named_struct('description', k, 'relevant_roles', cast(null as array<string>), 'industries', cast(null as array<string>), 'skills', cast(null as array<string>), 'target_audience_text', cast(null as string))"
    rows = spark.createDataFrame([(3, "a", []), (1, "b", ["c"]), (2, "c", []), (4, "d", []), (5, "d", [])], "at long, k string, sources array<string>").selectExpr("at", "at as pos", "k as key", "sources", f"{fields} as fields")
    found = rows.agg(F.collect_list(F.struct("*")).alias("v")).select(merge.unmerged(F.col("v"), F.array(F.lit("a"))).alias("x")).first().x
    assert [s.description for s in found.selected] == ["b", "d"] and found.covered == ["a", "b", "c", "d"]


def test_payloads_on_their_own(spark):
    whole = {"title": "a", "start_at": "2026-06-05T18:00", "timezone": "unknown", "language": "ru", "raw_text": "x", "event_type": "Festival"}
    rows = spark.createDataFrame([(json.dumps(x),) for x in (whole, whole | {"odd": 1}, [], whole | {"start_at": None}, whole | {"title": " "})], "payload string")
    assert [[(e.field, e.code) for e in r.errors] for r in extract.validated(rows).collect()] == [[], [("odd", "unexpected_field")], [("root", "invalid_type")], [("start_at", "missing_event_date")], [("title", "invalid_field")]]


def test_schemas_go_to_models_that_take_them(spark):
    class Bound:
        def complete_with_schema(self, system, user, schema):
            return json.dumps(sorted(schema))

    prompts = spark.createDataFrame([("a", "s", "u")], "prompt_key string, system string, user string")
    assert json.loads(models.answers(prompts, Bound, schema={"x": 1}, tasks=2).first().response) == ["x"]
    sent = []
    chat = models.ChatModel("u", "m", strict=True, post=lambda url, payload, headers, timeout: sent.append(payload) or json.dumps({"choices": [{"message": {"content": "{}"}}]}))
    chat.complete_with_schema("s", "u", {"type": "object"})
    assert sent[0]["response_format"]["json_schema"]["strict"] is True


class Given:
    def __init__(self, rows, errors=None):
        self.rows, self.errors, self.known = rows, errors, None

    def posts(self, cached_ids):
        self.known = cached_ids and sorted(r.external_id for r in cached_ids.collect())
        return self.rows, self.errors


def test_repeated_runs_of_a_pipeline(spark, tmp_path):
    path = str(tmp_path / "s.json")
    model = Steps(main=lambda asked: event(title=asked["text"], start_at="2026-06-05T18:00") if "fails" not in asked["text"] else 5, merge=lambda asked: 5)
    source = Given(posts(spark, "звезды", "fails"))
    run = pipeline.Pipeline(source, pipeline.Models(lambda: model), save_path=path)
    first = run.run(spark, today=today())
    assert source.known is None and [r.status for r in first.outcomes.orderBy("outcome_index").collect()] == ["extracted", "llm_error"]
    # a source with errors keeps what it doesn't bring, and failed outcomes are only asked for again if wanted
    source = Given(posts(spark, ("луна", "vk:wall-1_7", "2026-06-02T10:00:00"), ("fails", "vk:wall-1_1", "2026-06-02T10:00:00")), spark.createDataFrame([("down",)], "error string"))
    run = pipeline.Pipeline(source, pipeline.Models(lambda: model), previous_path=path, retry_llm_errors=False)
    second = run.run(spark, today=today())
    assert source.known == ["vk:wall-1_0", "vk:wall-1_1"]
    assert [(r.external_id, r.status, r.cached) for r in second.outcomes.orderBy("outcome_index").collect()] == [("vk:wall-1_7", "extracted", False), ("vk:wall-1_1", "llm_error", True), ("vk:wall-1_0", "extracted", None)]
    known = spark.createDataFrame([], first.outcomes.schema)
    assert run.resolved(spark, known) is known and run.resolved(spark, previous_path=path).count() == 2
    with pytest.raises(TypeError):
        pipeline.Pipeline(Given(spark.createDataFrame([("a",)], "text string")), pipeline.Models(lambda: model)).run(spark)


def test_labels_and_a_gate(spark):
    """A status without label is a mismatch; more mismatches than allowed are an error."""
    outcomes = spark.createDataFrame([("a", "extracted"), ("b", "skipped"), ("c", "skipped")], "external_id string, status string")
    gold = spark.createDataFrame([(0, "a", "extracted"), (1, "b", "extracted"), (2, "x", "skipped")], "post_pos long, external_id string, expected_status string")
    found = results.compared(outcomes, gold)
    assert [r.external_id for r in results.mismatches(found).collect()] == ["b", "c"] and results.mismatches(found, most=1).count() == 1
    assert results.gate(found, 2).first().mismatches == 2
    with pytest.raises(ValueError, match="2 mismatches, 1 allowed"):
        results.gate(found, 1)
    assert {tuple(r) for r in results.gold_summary(gold, 2).collect()} == {("extracted", 2)}


def test_errors_of_walls_keep_what_the_service_said():
    import pickle

    said = wall.WallClient("t", pace=models.Pace(), get=lambda url, timeout: json.dumps({"error": {"error_code": 15, "error_msg": "denied", "extra": 1}}))
    with pytest.raises(wall.WallError) as e:
        said.call("wall.get", {})
    again = pickle.loads(pickle.dumps(e.value))
    assert (again.code, again.method, again.details["extra"], str(again)) == (15, "wall.get", 1, "denied")
    assert pickle.loads(pickle.dumps(models.Pace(2.0))).seconds == 2.0


def test_walls_split_into_posts_and_errors(spark):
    rows = spark.createDataFrame([(1, 0, "b", None, "w", None, None, "i3", False, None), (0, 0, "a", None, "v", None, None, "i1", False, None), (0, 1, "c", None, "v", None, None, "i2", True, None), (2, 0, None, None, "x", None, None, None, None, "5: denied")], wall.SCHEMA)
    found, errors = wall.split(rows)
    assert found.schema.names == POST.names and [(r.post_pos, r.external_id) for r in found.orderBy("post_pos").collect()] == [(0, "i1"), (1, "i2"), (2, "i3")]
    assert [(r.source_pos, r.error) for r in errors.collect()] == [(2, "5: denied")]


def test_a_stream_of_posts_makes_snapshots(spark, tmp_path):
    """Each micro-batch is an incremental run against the snapshot before; a missing one doesn't matter."""
    folder = tmp_path / "in"
    folder.mkdir()
    for k, text in enumerate(("звезды 5 июня", "луна 6 июня")):
        posts(spark, (text, f"vk:wall-1_{k}", "2026-06-01T10:00:00")).coalesce(1).write.parquet(str(folder / f"p{k}"))
    stream = spark.readStream.schema(POST).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))

    def step(batch, last):
        if last is None:
            return pipeline.extract_batch(batch, pipeline.Models(lambda: Steps(main=lambda asked: event())), today=today()).outcomes.withColumn("cached", F.lit(False))
        return pipeline.extract_incremental(batch, last, pipeline.Models(lambda: Steps(main=lambda asked: event(title="Луна"))), today=today(), accumulate=True).outcomes

    incremental.into_snapshots(stream, str(tmp_path / "out"), step, str(tmp_path / "state"), trigger={"availableNow": True}).awaitTermination()
    last = incremental.latest(spark, str(tmp_path / "out"))
    assert sorted(r.external_id for r in last.collect()) == ["vk:wall-1_0", "vk:wall-1_1"] and snapshot.cached_ids(last).count() == 2
    assert post_files.load_snapshot(spark, str(tmp_path / "out" / "batch=0")).count() == 1
