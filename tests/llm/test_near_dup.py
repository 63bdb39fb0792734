import random
from collections import Counter
from itertools import combinations

from millrace.llm import near_dup


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return Counter((i, len(s), c := names.get(find(k)), i == c) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    texts = ["", " \n", None, "one", "One two", "one two", "one two three four", "ONE  two\tthree\nfour", "x y " * 40]
    passage = " ".join(word() for _ in range(60))
    for size in [1] * 30 + [2] * 10 + [5] * 4 + [60]:
        base = [word() for _ in range(r.choice([30, 80, 300]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, len(base) // 60 + 1)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy) + (" " + passage if r.random() < 0.2 else ""))
    texts += r.sample(texts, 20)
    r.shuffle(texts)
    return list(enumerate(texts)) + [(3, texts[3]), (3, "another text of the same id"), (None, "no id at all here"), (None, texts[10])]


def test_equal_to_brute_force(spark):
    rows = corpus()
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as node", "1 as label").repartition(3))
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_no_rows(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    r = random.Random(1)
    name = lambda k: f"{k * 7919 % 1009:04d}".encode()
    edges = [(k, k + 1) for k in range(0, 300) if k % 50] + [(400, k) for k in range(401, 500)] + [(r.randrange(600, 900), r.randrange(600, 900)) for _ in range(250)]
    up = list(range(1000))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        up[find(a)] = find(b)
    for alone in (10_000, 5):
        got = near_dup.components(spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary"), alone).collect()
        labels = {bytes(x.node): bytes(x.label) for x in got}
        ends = {k for e in edges if e[0] != e[1] for k in e}
        assert len(got) == len(labels) == len(ends)
        groups = {frozenset(k for k in ends if labels[name(k)] == x) for x in set(labels.values())}
        assert groups == {frozenset(k for k in ends if find(k) == x) for x in {find(k) for k in ends}}


def template_pages(n, own, seed=9):
    """Pages of one template, each with some words of its own: many lie near the least similarity, on both sides."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    base = [word() for _ in range(120)]
    rows = []
    for k in range(n):
        page = list(base)
        for _ in range(r.choice(own)):
            page[r.randrange(120)] = word()
        rows.append((k * 31, " ".join(page)))
    return rows


def test_large_regions_are_compared_in_blocks_and_deeper(spark):
    rows = template_pages(150, [2, 4, 6, 7, 8]) + [(10_000 + i, t) for i, t in template_pages(60, [9, 12], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    # regions and nearest neighbours find little here; blocks of 16 alone, then deeper orders for more than 40
    for forest in (near_dup.Forest(region=2, near=1, first=1, block=16), near_dup.Forest(region=2, near=1, first=1, block=16, deep=40)):
        assert Counter(tuple(r) for r in near_dup.near_duplicates(docs, forest).collect()) == want


def test_very_long_texts(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(30_000)]
    near = [w if k % 400 else "other" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(reversed(words))), (4, "a " * 100_000)]
    assert Counter(tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)
