import math
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from millrace.llm import mixing

ROWS = [(k, f"src{k % 7 if k % 3 else 0}", ["en", "de", "fr"][k % 11 % 3], ["plain words here " * (k % 5), "a | b | c |", "write x@y.z", "Copyright 2000"][k % 4]) for k in range(900)]
ROWS += [(5, "src1", "en", "again"), (5, "src1", "en", "again"), (None, None, None, "no id"), (901, "src2", None, None), (902, "only", "xx", "")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").selectExpr("*", "1 as topic", "2 as weight")


def test_equal_to_sql(spark):
    got = Counter(tuple(r) for r in mixing.mixture(frame(spark, ROWS)).collect())
    documents = pd.DataFrame(ROWS, columns=["doc_id", "source", "lang", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    assert got == Counter(map(tuple, duckdb.sql(mixing.sql()).fetchall()))


def test_marginals_are_met(spark):
    """Where no cap binds, the weights' marginals are the targets."""
    made = mixing.cells(frame(spark, ROWS[:900]), mixing.Mix(keep=0.02, rounds=40)).collect()
    total = sum(r.tokens for r in made)
    for d, power in (("_source", 0.5), ("_lang", 0.7), ("_topic", 0.7)):
        own, weight = defaultdict(float), defaultdict(float)
        for r in made:
            own[r[d]] += r.tokens
            weight[r[d]] += r.weight
        scale = sum(x**power for x in own.values())
        for x in own:
            assert math.isclose(weight[x], 0.02 * total * own[x] ** power / scale, rel_tol=0.02, abs_tol=1e-6), (d, x)
    assert all(r.weight <= r.tokens for r in made)


def test_explicit_targets_equal_sql_and_are_met(spark):
    mix = mixing.Mix(keep=0.02, rounds=60, targets=(("lang", (("en", 0.2), ("fr", 0.5), ("zz", 0.1))), ("topic", (("contact", 0.6),))))
    rows = ROWS[:900]
    got = Counter(tuple(r) for r in mixing.mixture(frame(spark, rows), mix).collect())
    documents = pd.DataFrame(rows, columns=["doc_id", "source", "lang", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    assert got == Counter(map(tuple, duckdb.sql(mixing.sql(mix)).fetchall()))
    told = {(r.dimension, r.value): r for r in mixing.report(frame(spark, rows), mix).collect()}
    total = sum(r.tokens for (d, _), r in told.items() if d == "lang")
    # zz doesn't occur: its share goes to all others, in proportion
    for key, share in ((("lang", "en"), 0.2), (("lang", "fr"), 0.5), (("lang", "de"), 0.3), (("topic", "contact"), 0.6)):
        assert math.isclose(told[key].target, 0.02 * total * share, rel_tol=1e-6), key
    assert all(abs(r.residual) < 1e-6 for r in told.values())
    greedy = {(r.dimension, r.value): r for r in mixing.report(frame(spark, rows), mixing.Mix(keep=0.9, targets=(("topic", (("legal", 0.9),)),))).collect()}
    # more than there is: all of it is taken, and the residual says so
    legal = greedy["topic", "legal"]
    assert math.isclose(legal.raked, legal.tokens, rel_tol=1e-6) and legal.residual < -0.1
    for bad in ((("lang", (("en", 1.2),)),), (("place", (("x", 0.1),)),)):
        with pytest.raises(ValueError):
            mixing.Mix(targets=bad)


def test_many_cells_are_raked_alike(spark, monkeypatch):
    """By joins, as for more cells than a task may hold."""
    few = {r[:3]: r.weight for r in mixing.cells(frame(spark, ROWS), mixing.Mix(rounds=3)).collect()}
    monkeypatch.setattr(mixing, "FEW", 2)
    many = {r[:3]: r.weight for r in mixing.cells(frame(spark, ROWS), mixing.Mix(rounds=3)).collect()}
    assert few.keys() == many.keys() and all(math.isclose(few[k], many[k], rel_tol=1e-9, abs_tol=1e-9) for k in few)


def test_very_long_texts(spark):
    rows = [(1, "a", "en", "word " * 100_000), (2, "a", "en", "x" * 500_000), (3, "b", "de", "12 " * 50_000)]
    got = {r.doc_id: (r.topic, r.n_tokens) for r in mixing.mixture(frame(spark, rows)).collect()}
    assert got == {1: ("long prose", 100_000), 2: ("long prose", 1), 3: ("numbers", 50_000)}


def test_sampling_keeps_columns_and_the_share(spark):
    docs = frame(spark, ROWS)
    got = mixing.sampled(docs, mixing.Mix(keep=0.5))
    assert got.columns == docs.columns
    tokens = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert 0.3 < tokens(got.collect()) / tokens(docs.collect()) < 0.6
    assert got.where("doc_id = 902").isEmpty()


def test_no_rows(spark):
    assert mixing.mixture(frame(spark, [])).collect() == []
