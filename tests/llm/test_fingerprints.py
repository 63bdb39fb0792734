import hashlib
import random
import struct

import xxhash
from pyspark.sql import functions as F

from millrace.llm import fingerprints as fp


def chain(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", v), seed)
    return seed


def sketch(text, k=fp.K):
    words = [xxhash.xxh64_intdigest(w, 42) for w in text.lower().encode().split()]
    if not words:
        return []
    if len(words) < 5:
        found = {chain(words)}
    else:
        two = [chain(x) for x in zip(words, words[1:], strict=False)]
        four = [chain(x) for x in zip(two, two[2:], strict=False)]
        found = {chain(x) for x in zip(four, words[4:], strict=False)}
    return sorted(x - 2**64 if x >= 2**63 else x for x in found)[:k]


def near(a, b, k=fp.K):
    u = sorted(set(a) | set(b))[:k]
    return len(set(u) & set(a) & set(b)) / len(u) if u else 1.0


def check(spark, rows):
    got = fp.compared(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _run", "'q' as edited").repartition(3)).collect()
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], (r[1] or "").encode()))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        a, b, c = sketch(t), sketch(edited), sketch(after)
        hexed = lambda s: "".join(f"{x % 2**64:016x}" for x in s)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), near(a, b), near(a, c)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)


def test_equal_to_brute_force(spark):
    r = random.Random(2)
    text = lambda: " ".join(r.choice("ab cd é 😀x yy\tz \n".split(" ")) for _ in range(r.choice([0, 1, 4, 5, 9, 300])))
    rows = [(r.choice([k, k * 1000, k * 10**9, -k]), text()) for k in range(200)]
    check(spark, rows + [(3, "twice"), (3, "twice"), (None, "no id"), (7, None), (8, "  lead and trail \n")])


def test_sparse_clustered_null_and_repeated_ids(spark, monkeypatch):
    """Cells of a few rows, so that every way of splitting them is taken."""
    monkeypatch.setattr(fp, "RUN", 4)
    monkeypatch.setattr(fp, "CROWDED", 8)
    r = random.Random(6)
    text = lambda: " ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) for _ in range(r.choice([1, 4, 12])))
    ids = [r.randrange(-(2**63), 2**63) for _ in range(60)] + list(range(500, 560)) + [None] * 60 + [7] * 40
    check(spark, [(i, text()) for i in ids] + [(9, "same text")] * 30)


def test_very_long_texts(spark):
    r = random.Random(3)
    check(spark, [(k, " ".join(r.choice("abcdef") * r.randint(1, 6) for _ in range(40_000))) for k in range(3)] + [(9, "word " * 60_000), (10, "x" * 300_000)])


def test_one_row_follows_itself(spark):
    check(spark, [(5, "one two three four five six seven eight")])


def test_no_rows(spark):
    assert fp.compared(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_estimates(spark):
    r = random.Random(1)
    base = [f"w{r.randrange(10**6)}" for _ in range(4000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:2000])), (3, " ".join(base[2000:]))]
    df = fp.sketched(spark.createDataFrame(rows, "doc_id long, text string"), "text", "s", 512)
    whole, half, other = (F.array(*map(F.lit, x.s)) for x in df.orderBy("doc_id").collect())
    row = spark.range(1).select(fp.resemblance(whole, half, 512), fp.containment(half, whole, 512), fp.distinct_shingles(whole, 512), fp.resemblance(half, other, 512)).first()
    assert abs(row[0] - 0.5) < 0.08 and row[1] > 0.9 and abs(row[2] / 3996 - 1) < 0.15 and row[3] == 0
    merged = fp.merged_groups(df.where("doc_id > 1").withColumn("g", F.lit(1)), ["g"], "s", 512).first().s
    assert len(set(merged) & set(df.orderBy("doc_id").first().s)) > 480
