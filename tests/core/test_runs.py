import json
import random
import urllib.error
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import dedup, extract, models, pipeline, results
from millrace.schemas import OUTCOME, POST
from millrace.sources import posts as post_files
from millrace.sources import wall

def today():
    return F.lit("2026-06-01").cast("date")



def posts(spark, *texts, first=0):
    ids = {}
    return spark.createDataFrame([(k, t, None, None, None, "2026-06-01T10:00:00", f"vk:wall-1_{ids.setdefault(t, k)}", False) for k, t in enumerate(texts, first)], POST)


class Scripted:
    """Answers by a word of the post; anything else fails."""

    def __init__(self, answers):
        self.answers = answers

    def complete(self, system, user):
        for word, answer in self.answers.items():
            if word in json.loads(user)["text"]:
                if answer == "daily":
                    raise models.ModelError("limit", daily=True)
                return answer if isinstance(answer, str) else json.dumps(answer)
        raise RuntimeError("no answer")


def event(**columns):
    return {"is_event": True, "event": {"title": "Лекция о звездах", "event_type": "educationevent", **columns}}


def run(spark, answers, *texts, **settings):
    return pipeline.extract_batch(posts(spark, *texts), lambda: Scripted(answers), pipeline.Settings(**settings), today=today())


def statuses(result):
    return [(r.outcome_index, r.status, r.errors[0].code if r.errors else None) for r in result.outcomes.orderBy("outcome_index").collect()]


def test_statuses_of_a_batch(spark):
    answers = {"звезды": event(), "bad": "not json", "list": '{"is_event": true}', "news": {"is_event": False, "skip_reason": "general_news"}, "undated": event(start_at=None), "odd": event(start_at="2026-06-05T18:00", end_at="2026-06-04T18:00")}
    got = run(spark, answers, "звезды 5 июня в 18:00", " ", "звезды 5 июня в 18:00 again", "bad", "list", "news", "undated", "odd", "Вчера состоялся концерт", "fails")
    assert statuses(got) == [
        (0, "extracted", None), (1, "skipped", "empty_post"), (2, "extracted", None), (3, "llm_error", "llm_error"), (4, "llm_error", "invalid_llm_shape"), (5, "skipped", "general_news"),
        (6, "invalid", "missing_event_date"), (7, "invalid", "invalid_field"), (8, "skipped", "past_event_report"), (9, "llm_error", "llm_error"),
    ]
    rows = got.events.orderBy("event_pos").collect()
    assert [(r.start_at, r.event_type, r.attendance_type, r.language, r.duplicate_of) for r in rows] == [(datetime(2026, 6, 5, 18), "EducationEvent", "OfflineEventAttendanceMode", "ru", 1), (datetime(2026, 6, 5, 18), "EducationEvent", "OfflineEventAttendanceMode", "ru", None)]
    counts = got.counts.first()
    assert (counts.total, counts.extracted, counts.error_count) == (10, 2, 5)


def test_error_budget_and_daily_latch_come_before_all_skips_but_repeats(spark):
    texts = ("fails", "news", "Вчера состоялся концерт", "fails", " ", "news 2")
    news = {"is_event": False, "skip_reason": "general_news"}
    over = "error_limit_reached"
    assert statuses(run(spark, {"news": news}, *texts, max_errors=1)) == [
        (0, "llm_error", "llm_error"), (1, "skipped", over), (2, "skipped", over), (3, "skipped", "duplicate_post"), (4, "skipped", "empty_post"), (5, "skipped", over),
    ]
    daily = "daily_rate_limit_exceeded"
    got = run(spark, {"fails": "daily", "news": news}, *texts, max_errors=3)
    assert statuses(got) == [(0, "llm_error", daily), (1, "llm_error", daily), (2, "llm_error", daily), (3, "skipped", "duplicate_post"), (4, "skipped", "empty_post"), (5, "skipped", over)]
    assert got.error_limit_reached
    with pytest.raises(ValueError):
        pipeline.Settings(max_errors=0)


def test_one_payload_with_listed_dates_becomes_two(spark):
    got = run(spark, {"встречи": event()}, "встречи 19 и 20 июня в 17:00")
    assert [r.start_at for r in got.events.orderBy("event_pos").collect()] == [datetime(2026, 6, 19, 17), datetime(2026, 6, 20, 17)]


def test_incremental_runs_ask_for_changes_alone(spark):
    first = run(spark, {"звезды": event()}, "звезды 5 июня в 18:00", "звезды 9 июня в 18:00").outcomes
    again = posts(spark, "звезды  5 июня в 18:00", "звезды 9 июня в 19:00")
    got = pipeline.extract_incremental(again, first, lambda: Scripted({"19:00": event()}), today=today())
    assert [(r.outcome_index, r.cached, r.status) for r in got.outcomes.orderBy("outcome_index").collect()] == [(0, True, "extracted"), (1, False, "extracted")]
    more = pipeline.extract_incremental(posts(spark, "звезды 7 июня в 18:00", first=5), first, lambda: Scripted({"звезды": event()}), today=today(), accumulate=True)
    assert more.outcomes.count() == 3


def graph(spark, n, pairs, of=lambda k: k, twins=()):
    """members, classes and pairs of classes; of: an event's class. Events of the classes in twins are duplicates of each other."""
    members = spark.createDataFrame([(k, of(k)) for k in range(n)], "event_pos long, class long")
    classes = spark.createDataFrame([(c, c in twins) for c in sorted({of(k) for k in range(n)})], "class long, is_pair boolean")
    return members, classes, spark.createDataFrame(pairs, "a long, b long")


def sequential(n, duplicate, ask=lambda a, b: None, most=32):
    """Groups of events in order, as a plain loop finds them; ask is consulted where duplicate() says nothing."""
    groups, decided = [], {}

    def same(i, k):
        known = duplicate(i, k)
        if known is not None:
            return known
        key = (min(i, k), max(i, k))
        if key not in decided:
            if len(decided) >= most:
                return False
            decided[key] = ask(*key)
        return decided[key]

    for i in range(n):
        group = next((g for g in groups if any(same(i, k) for k in g)), None)
        group.append(i) if group is not None else groups.append([i])
    return {k: g[0] for g in groups for k in g}, decided


def test_greedy_groups_are_not_components(spark):
    got = dedup.grouped(*graph(spark, 5, [(0, 2), (1, 2), (1, 3)])).collect()
    assert {r.event_pos: r.group_pos for r in got} == {0: 0, 1: 1, 2: 0, 3: 1, 4: 4}


@pytest.mark.parametrize("seed,most", [(1, 32), (2, 4), (3, 7)])
def test_groups_and_model_calls_are_those_of_a_loop(spark, seed, most):
    """Random duplicates among classes, and pairs that a model is asked about until the cap."""
    r = random.Random(seed)
    n = 60
    of = {k: (k if k % 3 else max(0, k - r.choice([0, 3, 6]))) for k in range(n)}
    of = {k: c if of.get(c) == c else k for k, c in of.items()}
    names = sorted(set(of.values()))
    pairs = {tuple(sorted(r.sample(names, 2))) for _ in range(25)}
    twins = {c for c in names if r.random() < 0.6}
    linked = lambda i, k: of[i] in twins if of[i] == of[k] else tuple(sorted((of[i], of[k]))) in pairs
    candidates = {(a, b) for a, b in (sorted(r.sample(range(n), 2)) for _ in range(40)) if not linked(a, b)}
    truth = {p: r.random() < 0.5 for p in candidates}
    want, decided = sequential(n, lambda i, k: True if linked(i, k) else None if tuple(sorted((i, k))) in candidates else False, lambda a, b: truth[a, b], most)
    members, classes, edges = graph(spark, n, sorted(pairs), of.__getitem__, twins)
    asked = []

    def decide(a, b):
        asked.append((a, b))
        return truth[a, b]

    same = dedup.consulted(members, classes, edges, spark.createDataFrame(sorted(candidates), "a long, b long"), decide, most)
    assert asked == list(decided) and same == [p for p in asked if truth[p]]
    extra = spark.createDataFrame(same, "a long, b long") if same else None
    assert {x.event_pos: x.group_pos for x in dedup.grouped(members, classes, edges, extra).collect()} == want


def test_drop_event(spark):
    got = run(spark, {"встречи": event()}, "встречи 19 и 20 июня в 17:00").outcomes
    one = results.drop_event(got, 0, 1)
    assert results.flat_events(one).count() == 1
    assert results.drop_event(one, 0).first().status == "skipped"
    with pytest.raises(IndexError):
        results.drop_event(got, 0, 7)


def test_text_functions(spark):
    df = spark.createDataFrame([("5 июня 🎉\n в 18:00 пройдет  лекция .",)], "t string")
    assert df.select(text.clean(F.col("t"))).first()[0] == "5 июня в 18:00 пройдет лекция."
    assert df.select(text.normalize_url(F.lit("HTTP://Tickets.Example:80/show/?utm_source=a&event=42#x."))).first()[0] == "https://tickets.example/show?event=42"
    urls = {
        "http://u:p@H.ex:8080/a/b/?b=%D0%B0+x&a=1&a=0&FBCLID=3&c&=v&d=%7E*%zz).": "https://h.ex:8080/a/b?=v&a=0&a=1&b=%D0%B0+x&c=&d=~%2A%25zz", "https://h:443": "https://h/", "http://h:443/x": "https://h:443/x", "https://h:99999/": None, "https://h:/y": "https://h/y", "ftp://h/": None, "https://": None, "https://h:x/": None,
    }
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", text.normalize_url(F.col("u")).alias("n")).collect()
    assert {r.u: r.n for r in got} == urls
    assert df.select(text.tokens(F.lit("Концерт в Ёлке и ёлка"))).first()[0] == ["елке", "елка"]
    assert df.select(text.tokens(F.lit("концерт"))).first()[0] == ["концерт"]


def test_snapshots_in_json(spark, tmp_path):
    got = run(spark, {"звезды": event(), "встречи": event(title="Встречи")}, "звезды 5 июня в 18:00", "встречи 19 и 20 июня в 17:00", " ").outcomes
    post_files.save_json(got, str(tmp_path / "s.json"))
    raw = json.loads((tmp_path / "s.json").read_text())
    assert [(o["status"], o["event"] and o["event"]["title"], o["events"] and len(o["events"]), o["post"]["external_id"]) for o in raw["outcomes"]] == [("extracted", "Лекция о звездах", None, "vk:wall-1_0"), ("extracted", "Встречи", 2, "vk:wall-1_1"), ("skipped", None, None, "vk:wall-1_2")]
    assert (raw["total"], raw["extracted"], raw["skipped"], raw["llm_errors"]) == (3, 2, 1, 0) and raw["outcomes"][0]["raw_llm_metadata"]["llm_attempts"][0]["stage"] == "main_extraction"
    back = post_files.load_json(spark, str(tmp_path / "s.json"))
    assert back.schema.names == OUTCOME.names
    pick = ["outcome_index", "status", "events", "text", "external_id", "errors"]
    assert sorted(map(str, back.select(*pick).collect())) == sorted(map(str, got.select(*pick).collect()))
    again = pipeline.extract_incremental(posts(spark, "звезды 5 июня в 18:00", "встречи 19 и 20 июня в 17:00"), back, lambda: Scripted({}), today=today())
    assert [(r.status, r.cached) for r in again.outcomes.orderBy("outcome_index").collect()] == [("extracted", True)] * 2
    (tmp_path / "p.json").write_text(json.dumps([{"text": " a ", "source_name": " "}, {"text": "b", "external_id": "x"}]))
    rows = post_files.json_posts(spark, str(tmp_path / "p.json")).orderBy("post_pos").collect()
    assert [(r.post_pos, r.text, r.source_name, r.external_id) for r in rows] == [(0, "a", None, None), (1, "b", None, "x")]
    assert [r.text for r in post_files.selected(post_files.json_posts(spark, str(tmp_path / "p.json")), ["x"]).collect()] == ["b"]


def test_walls():
    for given, want in {"-5": wall.Wall(-5), "club7": wall.Wall(-7), "id3": wall.Wall(3), "https://m.vk.com/public9?x": wall.Wall(-9), "https://vk.com/?w=wall-4_2": wall.Wall(-4), "name": wall.Wall(domain="name")}.items():
        assert wall.parse_wall(given) == want
    for bad in (" ", "https://other.example/a"):
        with pytest.raises(ValueError):
            wall.parse_wall(bad)


def test_wall_paging_refills_for_pinned_and_blank_posts():
    items = [{"id": 1, "text": "pinned", "is_pinned": 1, "date": 0}, {"id": 2, "text": " 🎉 "}, *({"id": k, "text": f"t{k}"} for k in range(3, 9))]

    def get(url, timeout):
        q = dict(x.split("=") for x in url.split("?")[1].split("&"))
        a = int(q["offset"])
        return json.dumps({"response": {"items": [i | {"owner_id": -1} for i in items[a : a + int(q["count"])]], "groups": [{"id": 1, "name": "G"}]}})

    client = wall.WallClient("t", pace=models.Pace(), get=get)
    got = list(wall.posts_of(client, wall.Wall(-1), limit=3, cached_ids=frozenset(["vk:wall-1_1"])))
    assert [p["external_id"] for p in got] == [f"vk:wall-1_{k}" for k in (1, 3, 4, 5)] and got[0]["published_at"] == "1970-01-01T00:00:00+00:00" and got[0]["source_name"] == "G"


def test_wall_retries():
    said, slept = [urllib.error.HTTPError("u", 503, "x", {"Retry-After": "2"}, None), json.dumps({"error": {"error_code": 6, "error_msg": "slow"}}), json.dumps({"response": {"ok": 1}})], []

    def get(url, timeout):
        if isinstance(x := said.pop(0), Exception):
            raise x
        return x

    assert wall.WallClient("t", pace=models.Pace(), get=get, sleep=slept.append).call("m", {}) == {"ok": 1}
    assert slept == [2.0, 2.0]
    said[:] = [json.dumps({"error": {"error_code": 5, "error_msg": "denied"}})]
    with pytest.raises(wall.WallError):
        wall.WallClient("t", pace=models.Pace(), get=get).call("m", {})


def test_model_limits():
    assert models.wait_after_429({"Retry-After": "3"}, "") == 3.25 and models.wait_after_429({}, "try again in 1m2s") == 62.25 and models.wait_after_429({}, "") == 60.25
    for headers, body in (({}, "limit on RPD"), ({"x-ratelimit-remaining-requests": "0"}, "")):
        with pytest.raises(models.ModelError) as e:
            models.wait_after_429(headers, body)
        assert e.value.daily


def test_stored_answers_are_not_asked_for(spark):
    prompts = spark.createDataFrame([("a", "s", '{"text": "x"}'), ("b", "s", '{"text": "y"}')], "prompt_key string, system string, user string")
    stored = spark.createDataFrame([("a", "kept", None)], models.ANSWERS)
    got = {r.prompt_key: (r.response, r.error) for r in models.answers(prompts, lambda: Scripted({"y": "daily"}), stored).collect()}
    assert got == {"a": ("kept", None), "b": (None, "daily_limit")}
    assert extract.response_schema()["required"] == ["is_event", "skip_reason", "event", "events"]
