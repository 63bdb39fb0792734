import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality
from millrace.llm.common import fold_column

SMALL = quality.Settings(buckets=256, epochs=20)


def corpus(n=400):
    r = random.Random(3)
    docs, labels = [], []
    for k in range(n):
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(20, 60))]
        good = r.random() < 0.7
        docs.append((k, " ".join(words if good else [w.upper() + "!!" for w in words] if r.random() < 0.5 else words[:2] * 20)))
        labels.append((k, int(good), 0))
    return docs, labels


def run(spark, docs, labels, s=SMALL):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as label", "2 as x").repartition(3)
    return quality.scored(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fold_column("doc_id", 4) != 2, s)


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    got = {r.doc_id: r.score for r in run(spark, docs, labels).collect()}
    held = [(got[i], q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 60 and np.mean([(p >= 0.7) == q for p, q in held]) > 0.97


def test_odd_rows_and_tables(spark):
    docs, labels = corpus(80)
    got = run(spark, docs + [(5, "again"), (5, "again"), (1000, None), (1001, ""), (None, "no id"), (1002, "x" * 100_000), (1003, "日本 😀 \x00")], labels + [(None, 1, 0), (7, None, 0), (8, 3, 0)]).collect()
    assert len(got) == 87 and all(0 <= r.score <= 1 for r in got)
    a, b = (r.score for r in got if r.doc_id in (1000, 1001))
    assert a == b
    assert run(spark, [], labels).collect() == []
    assert {r.score for r in run(spark, docs, []).collect()} == {0.5}
    assert {r.score for r in run(spark, docs, [(k, 1, 0) for k in range(9)]).collect()} == {1.0}


def test_extra_columns_stay(spark):
    docs, labels = corpus(60)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = quality.scored(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True), SMALL, "text string, lang string")
    assert got.columns == ["doc_id", "score", "text", "lang"] and sorted(r.text for r in got.collect()) == sorted(t for _, t in docs)


def test_vectors_and_features_equal_brute_force(spark):
    s = quality.Settings(buckets=64, size=8)
    texts = ["The cat sat, the cat RAN 12 times!", "", None, "one", "the the the", "Ünï x_y 7%%% cat"]
    places, signs = quality.index_vectors(s)
    table = np.zeros((2 * s.buckets, s.size))
    code = quality.Tokens(s.buckets)
    pair = lambda w: (int(code([w])[0]) >> 16, (int(code([w])[0]) & 0xFFFF) + s.buckets)
    for t in texts:
        words = (t or "").split()
        for a, b in zip(words, words[1:], strict=False):
            for x, y in zip(pair(a), pair(b), strict=True):
                for k in range(s.nonzero):
                    table[x, places[y, k]] += signs[y, k]
                    table[y, places[x, k]] += signs[x, k]
    want = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), s)
    assert np.allclose(got, want, atol=1e-6)
    features = quality.features_of([t or "" for t in texts], got, s)
    for t, f in zip(texts, features, strict=True):
        words = (t or "").split()
        if not words:
            assert not f.any()
            continue
        mean = lambda view: np.mean([want[pair(w)[view]] for w in words], axis=0)
        same = sum(pair(a) == pair(b) for a, b in zip(words, words[1:], strict=False))
        rest = [len(set(words)) / len(words), np.log1p(len(words)), same / len(words), len(t) / len(words) / 10]
        assert np.allclose(f, [*mean(0), *mean(1), *rest], atol=1e-5)


def test_network_and_temperature(spark):
    """The network's output layer by layer, its training on a set that it can separate, and the temperature that fits best."""
    r = np.random.default_rng(1)
    x = r.normal(size=(800, 12))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    net = quality.fit(x, y, quality.Settings(epochs=60))
    w1, b1, w2, b2 = net.layers
    for row in x[:20]:
        hidden = [max(0.0, sum(min(8, max(-8, (v - m) / q)) * w for v, m, q, w in zip(row, net.mean, net.scale, w1[:, k], strict=True)) + b1[k]) for k in range(len(b1))]
        logit = sum(h * w for h, w in zip(hidden, w2, strict=True)) + float(b2)
        assert abs(float(net(row[None])[0]) - 1 / (1 + np.exp(-logit / net.temperature))) < 1e-9
    fresh = r.normal(size=(500, 12))
    assert np.mean((net(fresh) > 0.5) == (fresh[:, 0] * fresh[:, 1] > 0)) > 0.85
    held = np.random.Generator(np.random.PCG64(7)).permutation(800)[:160]
    loss = lambda c: np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * net.logits(x[held]) / c).mean()
    assert all(loss(net.temperature) <= loss(c) + 1e-12 for c in np.geomspace(0.5, 8, 40))


def test_rows_that_repeat_an_id_are_learnt_from_alike(spark):
    docs, labels = corpus(120)
    many = docs + [(5, f"copy number {k}") for k in range(50)]
    scores = [sorted((r.doc_id, r.score) for r in run(spark, rows, labels).collect()) for rows in (many, many[::-1])]
    assert scores[0] == scores[1]
