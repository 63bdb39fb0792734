import hashlib
import random
import re

from millrace.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, d[::-1]))) % 10 == 0


def base(text):
    out = {}
    for kind, p in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            octet = lambda x: len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255
            checks = {"email": lambda m, d: True, "ip": lambda m, d: all(map(octet, m.split("."))), "card": lambda m, d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 9 <= len(d) <= 15}
            if checks[kind](m[0], d):
                out[kind].append((m.start(), m.end()))
    return out


def texts():
    r = random.Random(5)
    fixed = [None, "", "a@b.c_d@e.f.g x@y", "a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.0255 0.0.0.0", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (988) 555-2485, +49 30 1234", "😀é x@y.com é+1 (456) 555-2186", "1" * 20000, "a" * 50000 + "@", "a.b-c@" * 300, "1-" * 9000, "5" * 15000 + ".1.2.3", "+1" * 500]
    return fixed + ["".join(r.choice(["a", "b@", "@c", ".", "-", " ", "1", "23", "+", "(", ")", "4111111111111111", "é", "10.0.0.1", "_", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(400)]


def test_base_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as found", "2 as spans")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = base(t)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [len(want[k]) for k in PATTERNS], t
        joined = [f"{k}:{a}:{b}" for k in PATTERNS for a, b in want[k]]
        assert got[i].base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest(), t
        assert not set(joined) - set(got[i].spans.split(","))


def test_added_spans_and_redaction(spark):
    rows = [(i, f"call +1 (456) 555-21{i:02d} or mail ann{i}@mail.example.com now, item 12.34.56.789") for i in range(90)]
    rows += [(100, "phone (456) 555-2186 today"), (101, "write to bob (at) example (dot) com ok"), (102, "clean words only"), (103, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(docs).collect()}
    assert got[100].spans == "phone:6:20" and got[100].n_phone == 0 and got[101].spans == "email:9:35" and got[102].spans == got[103].spans == ""
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert clean[3] == "call <PHONE> or mail <EMAIL> now, item 12.34.56.789" and clean[100] == "phone <PHONE> today" and clean[103] == ""


def test_partly_overlapping_spans_are_redacted_whole(spark):
    """The card begins within the address and ends after it."""
    rows = [(1, "host 10.0.0.0 4111 1111 1111 1111 end"), (2, "4111 1111 1111 1111"), (3, "10.0.0.0 4111 1111 1111 1111, 10.0.0.1 x"), (4, None)]
    clean = {r.doc_id: r.text for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean == {1: "host <IP> end", 2: "<CARD>", 3: "<IP>, <IP> x", 4: ""}


def test_no_rows(spark):
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
