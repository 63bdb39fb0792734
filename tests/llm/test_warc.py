import gzip
import hashlib
from collections import Counter
from pathlib import Path

import pytest

from millrace.llm import warc

BIG, OTHER = "<p>é big</p>" * 100, "<p>other</p>" * 200
ROWS = [(1, "http://a/ 1", BIG), (2, "http://a/2", BIG), (7, None, BIG), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (8, "v", OTHER), (8, "v", OTHER), (9, "w", "x" * 999), (10, "w", "x" * 999), (11, "w", "y" * 1000), (12, "w", "y" * 1000), (None, "n", "y" * 1000)]


def brute(rows):
    last = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            last[h] = max(i, last.get(h, i))
    out = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        to = last.get(h) if len(raw) >= 1000 else None
        revisit = to is not None and to != i
        out[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None)] += 1
    return out


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as digest", "1 as salt")


def test_equal_to_brute_force(spark):
    got = warc.rewritten(pages(spark, ROWS)).drop("url").collect()
    assert Counter(tuple(r) for r in got) == brute(ROWS)


def test_many_copies(spark):
    rows = [(i, f"u{i}", BIG if i % 3 else OTHER if i % 2 else f"{i}" * 400) for i in range(3000)]
    assert Counter(tuple(r) for r in warc.rewritten(pages(spark, rows)).drop("url").collect()) == brute(rows)


def test_files(spark, tmp_path):
    made = warc.archives(warc.resolved(pages(spark, ROWS)))
    warc.export(made, f"file://{tmp_path}/out")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "out").iterdir())
    kinds = Counter(k[3] for k in brute(ROWS).elements())
    assert {k: raw.count(f"WARC-Type: {k}".encode()) for k in kinds} == kinds and raw.count(b"WARC-Type: warcinfo") == len(list(Path(tmp_path, "out").iterdir()))
    assert Counter(tuple(r) for r in warc.read(warc.files(spark, f"file://{tmp_path}/out")).drop("url").collect()) == brute(ROWS)
    ids = [line for line in raw.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    # but for the row that is there twice
    assert len(set(ids)) == len(ids) - 1


def test_very_long_pages(spark):
    rows = [(1, "u", "é" * 400_000), (2, "u", "é" * 400_000), (3, "u", "<p>x</p>" * 200_000)]
    assert Counter(tuple(r) for r in warc.rewritten(pages(spark, rows)).drop("url").collect()) == brute(rows)


def test_no_rows(spark):
    assert warc.rewritten(pages(spark, [])).collect() == []


def test_damage():
    good = gzip.compress(warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, None, "2024-01-01T00:00:00Z"))
    assert [h["warc-type"] for h, _ in warc.parse(good * 3)] == ["response"] * 3
    with pytest.raises(ValueError):
        list(warc.parse(good[:-9]))
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"nothing")))
