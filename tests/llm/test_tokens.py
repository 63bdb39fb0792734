import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import packing, token_counts

ODD = ["", " ", "  ", "a" * 3000, " " * 2500 + "b", "the" * 900, "<s> </s> <unk>", "a\x00b", "x\n\n\ty", "Ünï ▁ code 日本 😀", "<|endoftext|> a\x02b \x02 it's 12", "é ́", "\x1c\x85\xa0"]


def texts(n=300, seed=1):
    r = random.Random(seed)
    return ODD + ["".join(r.choice(" \n\tabcdeee▁éß<s>/0123日本😀thein") for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_counts_equal_the_library(spark):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    rows = list(enumerate(texts())) + [(9999, None), (9999, None)]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens"), file, limit=50).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=file)
    want = Counter((i, len((t or "").encode()), n := len(lib.encode(t or "")), n > 50) for i, t in rows)
    assert Counter(tuple(r) for r in got) == want


def test_counts_of_no_rows(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def check_packing(rows, got, size):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), size)):
            part = np.array(ids[at : at + size], "<u4")
            want[(i, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= size
    return bins


def test_packing(spark):
    rows = list(enumerate(texts())) + [(5, "same id"), (5, "same id"), (None, "no id"), (7, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as part", "0 as length").repartition(5), public_tokenizers.path("word_bpe_49k.json"), packing.Limits(tokens=64)).collect()
    bins = check_packing(rows, got, 64)
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 2


def test_only_its_own_tokenizer(spark):
    with pytest.raises(ValueError):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_of_all_kinds_equal_the_library():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    lib, ids = Tokenizer.from_file(file), packing.WordIds(file)
    given = texts(400, 5) + ["ÀÉ×÷ß ÿÜ", "İstanbul K Å ẞ", "ΟΔΟΣ ΣΑΣ", "a«b» ½ ² µ", "don't I'LL WE'RE", "<|startoftext|>x <|", "naïve café " * 50, "¡hola!", "\xad \x7f \x80", "word" * 2000]
    assert [np.frombuffer(x, "<u4").tolist() for x in ids(given)] == [lib.encode(t, add_special_tokens=False).ids for t in given]


def test_weights_change_the_plan():
    """Each residual counts: with other weights other sequences are chosen, and as few sequences are enough."""
    r = random.Random(8)
    lengths = Counter(min(2048, int(r.lognormvariate(5, 1)) + 1) for _ in range(20_000))
    least = -(-sum(k * n for k, n in lengths.items()) // 2048)
    for rule in ("norm", "dot"):
        plans = [packing.plan(lengths, packing.Limits(rule=rule, weights=w)) for w in ((1, 0, 0), (1, 0.1, 0.1), (1, 5, 0), (1, 0, 5))]
        assert len({tuple(p) for p in plans}) == 4
        for p in plans[:2]:
            assert max(first + n for _, _, n, first, _ in p) <= least + 2


def test_packing_of_very_long_texts(spark):
    rows = [(1, "word " * 60_000), (2, "x" * 20_000), (3, "日本 " * 20_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).collect()
    check_packing(rows, got, 2048)


def test_packing_of_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("pieces,attention", [(None, None), (3, None), (None, 1200), (4, 2000)])
def test_plan_keeps_every_limit(rule, pieces, attention):
    r = random.Random(3)
    limits = packing.Limits(64, pieces, attention, rule)
    lengths = Counter(r.randint(1, 30) for _ in range(3000))
    bins, ranks = defaultdict(list), defaultdict(set)
    for length, rank, n, first, offset in packing.plan(lengths, limits):
        for k in range(n):
            bins[first + k].append((offset, length))
            assert rank + k not in ranks[length]
            ranks[length].add(rank + k)
    assert {k: set(range(n)) for k, n in lengths.items()} == ranks
    for places in bins.values():
        assert sum(n for _, n in places) <= 64 and len(places) <= (pieces or 64) and sum(n * n for _, n in places) <= (attention or 64**2)
        assert [o for o, _ in sorted(places)] == np.cumsum([0] + [n for _, n in sorted(places)])[:-1].tolist()
    tokens, squares = sum(k * n for k, n in lengths.items()), sum(k * k * n for k, n in lengths.items())
    bound = max(tokens / 64, sum(lengths.values()) / (pieces or 64), squares / (attention or 64**2))
    assert len(bins) <= (1.2 if pieces else 1.1) * bound + 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_all_residuals_choose_the_sequence(rule):
    """The sequences' final states are those of dealing the pieces one by one, though only tokens bind."""
    r = random.Random(6)
    lengths, open_ = [r.randint(1, 40) for _ in range(400)], []
    for length in sorted(lengths, reverse=True):
        left = [tuple(a - b for a, b in zip(s, (length, 1, length**2), strict=True)) for s in open_]
        parts = lambda xs: [x / c for x, c in zip(xs, (64, 64, 64**2), strict=True)]
        norm = lambda k: sum(w * x * x for w, x in zip((1, 0.1, 0.1), parts(left[k]), strict=True))
        dot = lambda k: -sum(w * x * y for w, x, y in zip((1, 0.1, 0.1), parts(open_[k]), parts((length, 1, length**2)), strict=True))
        score = norm if rule == "norm" else dot
        k = min((k for k in range(len(open_)) if left[k][0] >= 0), key=score, default=None)
        if k is None:
            open_.append((64 - length, 63, 64**2 - length**2))
        else:
            open_[k] = left[k]
    made = defaultdict(lambda: (64, 64, 64**2))
    for length, _, n, first, _ in packing.plan(Counter(lengths), packing.Limits(64, rule=rule)):
        for k in range(first, first + n):
            made[k] = tuple(a - b for a, b in zip(made[k], (length, 1, length**2), strict=True))
    assert Counter(made.values()) == Counter(open_)


def test_a_piece_beyond_a_limit_is_an_error():
    with pytest.raises(ValueError):
        packing.plan({30: 1}, packing.Limits(64, None, 500))
