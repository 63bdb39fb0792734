r"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Candidates are the matches of strict patterns (valid or not, as an address of too large numbers or a card that fails its check
digit) and of loose ones (an address spelled with "at" and "dot", a national phone number, an IPv6 address). Five labelers vote
yes, no or nothing on each: the pattern's own check, a gazetteer (top-level domains, dialling codes, card issuers, address
ranges), the words before, the signs around, and the usual shape. Per kind, expectation-maximisation over the counted vote
patterns (at most 3**5) estimates how reliable each labeler is and so how likely each pattern is a true span. With these
probabilities as soft labels a final span classifier (naive Bayes over votes and shape features) is trained on the counts of all
candidates; a loose candidate that it gives at least `least` is added. Valid strict matches always stay.

The texts are read twice, row by row, with no shuffle of theirs: once for the counts, once for the spans. The driver gets the
classifier's weights, a few dozen numbers a kind.

Null text counts as empty: no spans. Candidates of equal votes and features have equal probabilities, and so are added or left out
together. Repeated rows are marked each. An empty table gives no rows. Of further columns, those of
`keep` stay.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import kept

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
HOST = "[A-Za-z0-9-]"
#: The base patterns. Possessive, as no step back could lead to a match, and bound to the start of a run of the first class or
#: the end of the last match, where the leftmost match begins: both keep long runs from costs that grow with their square.
STRICT = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?i)(?<!{LOCAL}){LOCAL}{{1,64}}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?{HOST}{{1,63}}+\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z]{{2,12}}\b",
    "ip": r"(?i)(?<![0-9a-z:.])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-z:.])",
    "card": "",
    "phone": r"(?<![0-9+(.-])(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}(?![0-9.-])",
}
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|eu|uk|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|fi|dk|ie|us|ca|au|nz|jp|cn|in|br|mx|ru|ua|cz|gr|tr|kr|za"
ISSUERS = r"^(?:4[0-9]{12}|4[0-9]{15}|4[0-9]{18}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14})$"
CALLING = r"^\+(?:1[2-9]|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-9][0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]|85[0-9]|9[67][0-9])"
WORDS = {
    "email": "e-?mail|contact|write to|reach|correo|courriel",
    "ip": r"\bips?\b|host|server|address|ping|node|gateway",
    "card": "card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel\b|mobile|\bcall\b|\bfax\b|cell|telefon|téléphone|teléfono",
}
NOT_WORDS = r"isbn|issn|order|invoice|serial|version|\bsku\b|\bdoi\b|build|patent|article"
ROUNDS = 25
SMOOTH = 0.5
SHRINK = 4.0
#: Values of each feature of a span: five votes, length, digits, and the sign before.
SIZES = (3, 3, 3, 3, 3, 6, 6, 4)


#: What a text must have for a pattern to match anywhere; most texts have none of it and are spared the patterns.
NEEDS = {
    "email": "contains(text, '@')",
    "ip": "rlike(text, '[0-9][.][0-9]')",
    "card": "rlike(text, '[0-9][ -]?[0-9]')",
    "phone": "contains(text, '+')",
}
LOOSELY_NEEDS = {
    "email": "rlike(text, '(?i)[( \\\\[]dot[) \\\\]]') and rlike(text, '(?i)[( \\\\[]at[) \\\\]]')",
    "ip": "rlike(text, '[0-9A-Fa-f]:[0-9A-Fa-f]')",
    "phone": "rlike(text, '[0-9]{3}[ .-][0-9]{4}')",
}


def _matches(kind: str, pattern: str, base: bool) -> str:
    """SQL for an array of the matches of a pattern in the column text, with their places and what is around them."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    need, none = (NEEDS if base else LOOSELY_NEEDS)[kind], f"cast(array() as array<{SPAN}>)"
    return f"""case when not ({need}) then {none} else
        aggregate(
            transform(regexp_extract_all(text, '{p}', 0), (h, i) -> struct(h, i)),
            named_struct('at', 0, 'gaps', split(text, '{p}', -1), 'out', cast(array() as array<{SPAN}>)),
            (s, x) -> named_struct(
                'at', s.at + length(s.gaps[x.i]) + length(x.h),
                'gaps', s.gaps,
                'out', concat(s.out, array(named_struct(
                    'kind', '{kind}', 'start', s.at + length(s.gaps[x.i]), 'end', s.at + length(s.gaps[x.i]) + length(x.h), 'hit', x.h,
                    'before', right(s.gaps[x.i], 24), 'after', left(s.gaps[x.i + 1], 1), 'strict', {str(base).lower()})))),
            s -> s.out) end"""


SPAN = "struct<kind:string,start:int,end:int,hit:string,before:string,after:string,strict:boolean>"
DIGITS = "regexp_replace(c.hit, '[^0-9]', '')"


def _checked() -> str:
    """SQL: whether a strict match c holds."""
    luhn = """aggregate(sequence(1, length(d)), 0, (s, i) -> s + (case when i % 2 = 1 then cast(substr(d, -i, 1) as int)
        when cast(substr(d, -i, 1) as int) > 4 then 2 * cast(substr(d, -i, 1) as int) - 9 else 2 * cast(substr(d, -i, 1) as int) end)) % 10 = 0"""
    return f"""case c.kind when 'email' then true
        when 'ip' then forall(split(c.hit, '[.]'), x -> length(ltrim('0', x)) <= 3 and cast(concat('0', right(ltrim('0', x), 3)) as int) <= 255)
        when 'card' then exists(array({DIGITS}), d -> length(d) between 13 and 19 and {luhn})
        else length({DIGITS}) between 9 and 15 end"""


def _votes() -> str:
    """SQL: the labelers' votes on a candidate c (2 yes, 1 nothing, 0 no) and its shape features, as an array of numbers."""
    vote = lambda yes, no: f"(case when {yes} then 2 when {no} then 0 else 1 end)"
    quoted = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    of = lambda by: "(case c.kind " + " ".join(f"when '{k}' then {x}" for k, x in by.items()) + " end)"
    check = vote("c.strict and c.valid", "c.strict")
    gazetteer = of(
        {
            "email": vote(f"rlike(lower(c.hit), {quoted(f'(?:[.]|dot[^a-z]*)(?:{DOMAINS})$')})", "true"),
            "ip": vote("contains(c.hit, ':')", "rlike(c.hit, '^0|(^|[.])[0-9]{4}|^[0-9][.][0-9][.][0-9][.][0-9]$|^(22[4-9]|2[3-9][0-9])')").replace("else 1", "else 2"),
            "card": vote(f"rlike({DIGITS}, {quoted(ISSUERS)})", "true"),
            "phone": vote(f"rlike(regexp_replace(c.hit, '[^0-9+]', ''), {quoted(CALLING)})", "c.strict"),
        }
    )
    words = of({k: vote(f"rlike(lower(c.before), {quoted(w)})", f"rlike(lower(c.before), {quoted(NOT_WORDS)})") for k, w in WORDS.items()})
    around = vote("rlike(c.before, '(^|[^A-Za-z0-9_=/.-])$') and rlike(c.after, '^($|[^A-Za-z0-9_=/-])')", "true")
    shape = of(
        {
            "email": vote("length(c.hit) between 6 and 64", "true"),
            "ip": vote("length(c.hit) between 9 and 39", "true"),
            "card": vote(f"length({DIGITS}) in (15, 16)", "true"),
            "phone": vote(f"length({DIGITS}) between 10 and 13", "true"),
        }
    )
    before = "(case when c.before = '' then 0 when rlike(c.before, '[\\\\s]$') then 1 when rlike(c.before, '[(:,;]$') then 2 else 3 end)"
    return f"array({check}, {gazetteer}, {words}, {around}, {shape}, least(5, length(c.hit) div 6), least(5, length({DIGITS}) div 4), {before})"


def candidates(docs: DataFrame) -> DataFrame:
    """docs with found: an array of all candidates, with valid (a strict match that holds) and features.

    Loose matches that overlap a valid strict one are no candidates.
    """
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    docs = docs.withColumn("found", F.expr("concat(" + ", ".join(_matches(k, STRICT[k], True) for k in KINDS) + ")"))
    docs = docs.withColumn("loose", F.expr("concat(" + ", ".join(_matches(k, LOOSE[k], False) for k in KINDS if LOOSE[k]) + ")"))
    checked = "transform({}, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'hit', c.hit, 'before', c.before, 'after', c.after, 'strict', c.strict, 'valid', c.strict and {}))"
    docs = docs.withColumn("found", F.expr(checked.format("found", _checked())))
    apart = "filter(loose, a -> not exists(found, b -> b.valid and a.start < b.end and b.start < a.end))"
    docs = docs.withColumn("found", F.expr(f"concat(found, {checked.format(apart, 'false')})")).drop("loose")
    return docs.withColumn("found", F.expr(f"transform(found, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'strict', c.strict, 'valid', c.valid, 'features', {_votes()}))"))


def reliabilities(patterns: DataFrame) -> DataFrame:
    """kind, votes, p: how likely each vote pattern is a true span, by expectation-maximisation for each kind.

    patterns: kind, votes, n. A kind has at most 3**5 patterns, which is the bound of its array.
    """
    rows = patterns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("pats"))
    total = lambda x: f"aggregate(zip_with(pats, q, (p, x) -> {x}), 0D, (a, b) -> a + b)"
    seen = lambda x: f"transform(sequence(0, 14), k -> {SMOOTH} + {total(f'if(p.votes[k div 3] = k % 3, {x}, 0D)')})"
    # a labeler that says nothing is no evidence
    ratio = lambda j: f"ln(m.yes[{3 * j} + p.votes[{j}]] / (m.yes[{3 * j}] + m.yes[{3 * j + 2}])) - ln(m.no[{3 * j} + p.votes[{j}]] / (m.no[{3 * j}] + m.no[{3 * j + 2}]))"
    odds = " + ".join(f"if(p.votes[{j}] = 1, 0D, {ratio(j)})" for j in range(5))
    start = "transform(pats, p -> (1D + size(filter(p.votes, v -> v = 2))) / (2D + size(filter(p.votes, v -> v != 1))))"
    step = f"""transform(
        array(named_struct('n_yes', {total("p.n * x")}, 'n_no', {total("p.n * (1 - x)")}, 'yes', {seen("p.n * x")}, 'no', {seen("p.n * (1 - x)")})),
        m -> transform(pats, p -> 1 / (1 + exp(-greatest(-30D, least(30D, ln((m.n_yes + 1) / (m.n_no + 1)) + {odds}))))))[0]"""
    fitted = rows.withColumn("q", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (q, k) -> {step})"))
    return fitted.select("kind", F.explode(F.arrays_zip("pats", "q")).alias("x")).select("kind", "x.pats.votes", F.col("x.q").alias("p"))


def train(found: DataFrame) -> dict[str, list[float]]:
    """The final classifier's weights by kind, from candidates' arrays: a log-odds for each value of each feature, then the prior."""
    each = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.features").agg(F.count("*").alias("n"))
    counted = kept(each, "votes").withColumn("votes", F.slice("features", 1, 5))
    soft = counted.join(F.broadcast(reliabilities(counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")))), ["kind", "votes"])
    parts = soft.select("kind", F.posexplode("features").alias("feature", "value"), (F.col("n") * F.col("p")).alias("yes"), (F.col("n") * (1 - F.col("p"))).alias("no"))
    sums = parts.groupBy("kind", "feature", "value").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    weights = {}
    for kind in KINDS:
        of = {(r.feature, r.value): (r.yes, r.no) for r in sums if r.kind == kind}
        yes, no = (sum(x[k] for (f, _), x in of.items() if f == 0) for k in (0, 1))
        flat = []
        for feature, size in enumerate(SIZES):
            for value in range(size):
                a, b = of.get((feature, value), (0.0, 0.0))
                # drawn to the value's share among all, so that a class of few spans says little
                if feature < 5 and value == 1:  # no vote
                    flat.append((1.0, 1.0))
                    continue
                share = SHRINK * (a + b + SMOOTH) / (yes + no + SMOOTH * size)
                flat.append(((a + share) / (yes + SHRINK), (b + share) / (no + SHRINK)))
        weights[kind] = [*flat, (yes + 1, no + 1)]
    return {k: [log(a / b) for a, b in v] for k, v in weights.items()}


def spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: float = 0.95) -> DataFrame:
    """The columns of keep, text, base (the valid strict spans) and spans (these and the added), each by kind, then start."""
    found = candidates(docs.select(*dict.fromkeys((*keep, "text"))))
    weights = train(found.select("found"))
    firsts = [sum(SIZES[:k]) for k in range(len(SIZES))]
    arrays = " ".join(f"when '{k}' then array({', '.join(f'{x!r}D' for x in w)})" for k, w in weights.items())
    score = " + ".join(f"w[{first} + c.features[{k}]]" for k, first in enumerate(firsts)) + f" + w[{sum(SIZES)}]"
    sure = f"exists(array(case c.kind {arrays} end), w -> 1 / (1 + exp(-({score}))) >= {least}D)"
    ranks = "array('email', 'ip', 'card', 'phone')"
    plain = "transform(array_sort(transform({}, c -> struct(array_position(" + ranks + ", c.kind) as rank, c.start as start, c.end as end))), c -> struct(" + ranks + "[int(c.rank) - 1] as kind, c.start as start, c.end as end))"
    found = found.withColumn("base", F.expr(plain.format("filter(found, c -> c.valid)")))
    return found.withColumn("spans", F.expr(plain.format(f"filter(found, c -> c.valid or (not c.strict and {sure}))"))).drop("found")


def joined(column: str):
    return F.expr(f"array_join(transform({column}, c -> concat(c.kind, ':', c.start, ':', c.end)), ',')")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of base spans by kind, base_sha256, spans."""
    count = lambda kind: F.expr(f"cast(size(filter(base, c -> c.kind = '{kind}')) as long)").alias(f"n_{kind}")
    return spans(docs).select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with a sign for the kind, as <EMAIL>, in place of each span; overlapping spans are one, by the kind of the first, then longest."""
    marked = spans(docs, tuple(docs.columns))
    step = """(s, c) -> if(c.start < s.at, named_struct('at', greatest(s.at, c.end), 'out', s.out), named_struct('at', c.end, 'out', concat(s.out, array(substr(text, s.at + 1, c.start - s.at), concat('<', upper(c.kind), '>')))))"""
    ordered = "array_sort(transform(spans, c -> struct(c.start as start, -c.end as last, c.end as end, c.kind as kind)))"
    text = f"aggregate({ordered}, named_struct('at', 0, 'out', cast(array() as array<string>)), {step}, s -> concat(array_join(s.out, ''), substr(text, s.at + 1)))"
    changed = F.when(F.size("spans") > 0, F.expr(text)).otherwise(F.col("text"))
    return marked.withColumn("text", changed).select(*docs.columns)
