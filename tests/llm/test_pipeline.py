import random
from collections import Counter

import corpus_pipeline as cp
import pytest
from millrace.llm import mixing
from pyspark.sql import functions as F

from tests.llm.test_tokens import check_packing


@pytest.fixture
def sf_dir(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for k in range(160):
        words = [word() for _ in range(r.randint(30, 60))]
        bad = k % 4 == 0
        docs.append((k, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + f" mail me{k}@mail.example.com", ["en", "de"][k % 2], f"src{k % 3}"))
        labels.append((k, int(not bad), 0))
    docs += [(200 + k, docs[k][1], "en", "src0") for k in range(1, 160, 9)] + [(400, docs[5][1] + " more", "en", "src1"), (5, docs[5][1], "de", "src2")]
    rows = [(i, t, lang, source, len(t)) for i, t, lang, source in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for _, stage in cp.STAGES:
        tables.append(stage(spark, tables[-1], sf_dir).cache())
    raw, good, single, clean, mixed, pieces = tables
    assert all(t.columns == docs.columns for t in tables[:-1])
    bad = {k for k in range(0, 160, 4)} | {200 + k for k in range(1, 160, 9) if k % 4 == 0}
    want = Counter(r.doc_id for r in raw.collect() if r.doc_id not in bad)
    assert Counter(r.doc_id for r in good.collect()) == want
    assert Counter(r.doc_id for r in single.collect()) == Counter(k for k in range(160) if k % 4)
    assert all(r.text.endswith("mail <EMAIL>") and r.n_chars == len(r.text) for r in clean.collect()) and clean.count() == single.count()
    drawn = {r.doc_id for r in mixing.mixture(clean).collect() if r.sampled}
    assert {r.doc_id for r in mixed.collect()} == drawn and 0 < len(drawn) < clean.count()
    check_packing([(r.doc_id, r.text) for r in mixed.collect()], pieces.collect(), 2048)
    assert Counter(tuple(r)[:5] for r in cp.run(spark, sf_dir).collect()) == Counter(tuple(r)[:5] for r in pieces.collect())


def test_stages_of_no_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []


def test_odd_rows_pass_all_stages(spark, sf_dir):
    """Null in any column, empty and very long texts, repeated rows and ids, and columns of clashing names."""
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a " * 30_000, "en", "s", 60_000), (2, "b c", "en", "s", 3), (2, "b c", "en", "s", 3), (None, "no id at all here", None, "s", None)]
    docs = spark.createDataFrame(rows, cp.SCHEMA).selectExpr("*", "1 as score", "'x' as node", "2 as label", "3 as sketch", "4 as length", "5 as weight", "6 as s")
    names = list(cp.COLUMNS)
    good = cp.good_quality(spark, docs, sf_dir)
    scores = {r.doc_id: r.score for r in cp.quality.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True)).collect() if r.doc_id == 1}
    assert good.columns == names and all(0 <= x <= 1 for x in scores.values()) and good.count() <= len(rows)
    single = cp.without_near_copies(spark, docs, sf_dir)
    assert single.columns == names and Counter((r.doc_id, r.text) for r in single.collect()) == Counter([(1, None), (None, ""), (2, "a " * 30_000), (2, "b c"), (None, "no id at all here")])
    clean = cp.without_personal_data(spark, docs, sf_dir)
    assert clean.columns == names and Counter((r.doc_id, r.text, r.n_chars) for r in clean.collect()) == Counter((i, t or "", len(t or "")) for i, t, *_ in rows)
    mixed = cp.mixed(spark, docs, sf_dir)
    assert mixed.columns == names and not Counter(map(tuple, mixed.collect())) - Counter(rows)
    check_packing([r[:2] for r in rows], cp.packed(spark, docs, sf_dir).collect(), 2048)
    made = docs
    for _, stage in cp.STAGES:
        made = stage(spark, made, sf_dir)
    assert all(r.length <= 2048 for r in made.collect())
