"""Pairs are as many as their SQL says, while what is shuffled follows the rows."""

from collections import Counter

from pyspark import TaskContext
from pyspark.sql import functions as F

from millrace.operators import dedup, extract, guards, models
from millrace.plans import catalog


def shuffled(spark, run):
    """What run() gives, and how many rows its stages wrote to shuffles."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = gateway.jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = set(total())
    found = run()
    return found, sum(n for k, n in total().items() if k not in before)


def linked(spark, rows):
    """Events (event_pos, title, text, event_type, place) of one day."""
    events = spark.createDataFrame(rows, "event_pos long, title string, prompt_text string, event_type string, venue_name string")
    at = F.lit("2024-05-01 10:00:00").cast("timestamp_ntz")
    return events.withColumns({"description": F.lit(None).cast("string"), "address": F.lit(None).cast("string"), "start_at": at, "end_at": at})


def test_pairs_of_a_frequent_link_are_judged_where_they_meet(spark):
    events = linked(spark, [(k, f"клуб {k}", f"https://t.example/a слово{k}", "Festival" if k % 4 else "MusicEvent", None) for k in range(1000)])
    n, rows = shuffled(spark, lambda: dedup.semantic_pairs(events).count())
    assert n == 750 * 749 // 2 + 250 * 249 // 2 and rows < 50_000


def test_a_pair_comes_once_however_it_is_found(spark, monkeypatch):
    monkeypatch.setattr(dedup, "LINKED", 3)
    a, b = "https://t.example/a", "https://t.example/b"
    texts = [f"{a} {b} ночь огней", f"{b} ночь огней {a}", f"{a} ночь", "ночь огней", f"{b} утро", "утро"] * 3
    events = [(k, f"клуб {k}", x, ("Festival", "unknown", "Festival", "MusicEvent")[k % 4], ("Зал 1", None, "Зал 2")[k % 3]) for k, x in enumerate(texts)]
    made = linked(spark, events)
    facts = made.select("event_pos", F.struct(*[c.alias(n) for n, c in dedup.rules.semantic_facts().items()]).alias("e"))
    both = facts.toDF("a", "x").crossJoin(facts.toDF("b", "y")).where("a < b")
    want = Counter(tuple(r) for r in both.where(dedup.rules.need_semantic_check(F.col("x"), F.col("y"))).select("a", "b").collect())
    assert len(want) > 30 and Counter(tuple(r) for r in dedup.semantic_pairs(made).collect()) == want


def test_pairs_of_equal_titles_come_out_of_blocks(spark):
    part = spark.createDataFrame([(k, ("large ring", "large ring bolt", "hot plate")[k % 3], 1) for k in range(1500)], "p_partkey long, p_name string, p_size int")
    found, rows = shuffled(spark, lambda: dedup.duplicate_pairs(catalog._titled(part), n=F.size("x.title_set") + F.size("y.title_set")).where("a < b").select("a", "b", "n").collect())
    want = {(a, b): 4 + (a % 3 == 1) + (b % 3 == 1) for a in range(1500) for b in range(a + 1, 1500) if (a % 3 == 2) == (b % 3 == 2)}
    assert len(found) == len(want) and {(r.a, r.b): r.n for r in found} == want
    assert rows < 50_000


def test_places_are_compared_once_for_many_rows(spark, tmp_path):
    for name, n, key, nation in (("supplier", 300, "s_suppkey", "s_nationkey"), ("customer", 1500, "c_custkey", "c_nationkey")):
        spark.range(n).select(F.col("id").alias(key), F.when(F.col("id") % 10 != 0, F.col("id") % 2).alias(nation)).write.parquet(f"{tmp_path}/{name}.parquet")
    found, rows = shuffled(spark, lambda: catalog.location_similarity(spark, str(tmp_path)).collect())
    want = {(s, c): s % 7 == c % 7 or s % 5 == c % 7 for s in range(300) for c in range(1500) if s % 10 and c % 10 and s % 2 == c % 2}
    assert len(found) == len(want) and {(r.s_suppkey, r.c_custkey): r.near for r in found} == want and rows < 20_000
    # words of places are found before rows meet
    plan = catalog.location_similarity(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in plan[: plan.index("Join ")]


def test_similar_places_with_nulls(spark):
    halls = [(0, 1, "Зал Б", None), (1, 1, None, "большой зал б"), (2, 1, None, None), (3, None, "Зал Б", None), (4, 1, "Клуб", "Зал Б")]
    at = spark.createDataFrame(halls, "pos long, nation int, address string, venue_name string")
    found = {(r.p, r.q): r.near for r in dedup.located_pairs(at, at, "nation").collect()}
    assert found == {(p, q): 2 not in (p, q) for p in (0, 1, 2, 4) for q in (0, 1, 2, 4)}


def test_guards_and_outcomes_are_spread_and_judged_once(spark):
    posts = catalog._posts(spark, "/root/testdata/sf0.001")
    assert guards.guarded(posts, F.lit("2024-01-01").cast("date")).select("guard").rdd.getNumPartitions() == 4
    answered = guards.guarded(posts, F.lit("2024-01-01").cast("date")).withColumns({"response": F.lit('{"is_event": false}'), "error": F.lit(None).cast("string")})
    plan = extract.outcomes(answered, F.lit("2024-01-01").cast("date"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "Join" not in plan


class Teller:
    """Answers with the task that asks."""

    def complete(self, system, user):
        return str(TaskContext.get().partitionId())


def test_models_are_asked_in_many_tasks(spark):
    prompts = spark.createDataFrame([(f"k{k}", "s", f"u{k}") for k in range(64)], "prompt_key string, system string, user string")
    found = models.answers(prompts, Teller).collect()
    assert len(found) == 64 and len({r.response for r in found}) == 4
