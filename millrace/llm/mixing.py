"""Mixing sources to target weights by iterative proportional fitting, in DataFrame and SQL functions alone.

Token counts are summed by cell (source, language, topic). Raking scales the cells' weights to the target share of each source,
then of each language and topic, and again, and caps each cell at the tokens it has, so that a share that can't be had goes to
the others. A document is then kept with its cell's weight over its cell's tokens as probability, by a hash of its id.

Only the cells are shuffled (a row for each cell that occurs, after partial sums); the texts are read twice, with no shuffle.

Null text has no tokens; null source or language counts as "(none)". Cells without tokens have probability 0. Repeated rows and
equal ids are drawn alike, null ids like an empty one. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import kept, small

DIMENSIONS = ("source", "lang", "topic")
#: Cells, or values of a marginal, that one task may hold; and rounds that it goes through before it writes them.
FEW, ROUNDS = 100_000, 4
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """What marginals to rake to. targets: for a dimension (source, lang or topic), the shares of tokens that its values should
    have; values that aren't named divide what is left by their own shares, and named ones that don't occur leave theirs to the
    others. A dimension without targets is to have its own shares to the power given, scaled to 1: 1 leaves a marginal as it is, 0
    makes its values equal. keep: the share of all tokens to keep. rounds: of raking, at most; it ends before where no weight
    changes by more than tolerance. salt: another draws another sample."""

    source: float = 0.5
    lang: float = 0.7
    topic: float = 0.7
    keep: float = 0.5
    rounds: int = 24
    tolerance: float = 1e-12
    salt: str = "mix"
    targets: tuple[tuple[str, tuple[tuple[str, float], ...]], ...] = ()

    def __post_init__(self):
        for d, named in self.targets:
            if d not in DIMENSIONS or sum(x for _, x in named) > 1 + 1e-9 or any(x < 0 for _, x in named):
                raise ValueError(f"targets of {d} must be of {DIMENSIONS}, not negative and 1 at most together")

    def of(self, dimension: str) -> dict[str, float]:
        return dict(dict(self.targets).get(dimension, ()))


def topic(text: Column) -> Column:
    """A topic by form: what is written in tables, contact data, licences, numbers or lists, and otherwise prose by its length."""
    n = F.greatest(F.length(text), F.lit(1))
    count = lambda sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    low = F.lower(text)
    return (
        F.when(count("|") * 50 >= n, "tabular").when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(low, F.lit("license")) | F.contains(low, F.lit("copyright")), "legal")
        .when(digits * 5 >= n, "numbers").when(count("\n") * 40 >= n, "list")
        .when(n < 1000, "short prose").otherwise("long prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """docs with _source, _lang, _topic and _tokens."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for c in ("source", "lang")} | {"_topic": topic(text), "_tokens": F.regexp_count(text, F.lit(WORD)).cast("long")})


def shares(rows: DataFrame, d: str, mix: Mix) -> DataFrame:
    """_d and share: what its values are to have of all tokens kept, 1 together."""
    own = kept(rows.groupBy(f"_{d}").agg(F.sum("tokens").cast("double").alias("own")), "own")
    named = mix.of(d)
    if not named:
        part = F.when(F.col("own") > 0, F.pow("own", F.lit(getattr(mix, d)))).otherwise(0.0)
    else:
        given = F.when(F.col("own") > 0, F.try_element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col(f"_{d}")))
        there, rest = own.agg(F.coalesce(F.sum(given), F.lit(0.0)), F.sum(F.when(given.isNull(), F.col("own")))).first()
        part = F.coalesce(given, F.col("own") * F.lit((1 - there) / rest if rest else 0.0))
    parts = own.select(f"_{d}", part.alias("part"))
    scale = parts.agg(F.sum("part")).first()[0] or 1.0
    return parts.select(f"_{d}", (F.col("part") / F.lit(scale)).alias("share"))


def cells(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """_source, _lang, _topic, tokens, weight (the raked weight of each cell in tokens), and what each marginal is to have: to_source
    and so on.

    A round scales each marginal to its target in turn, then cuts weights at what the cell has; so targets that ask for more than
    there is are not met, which report() shows. Up to FEW cells are one task's work; of more, sums come from partial sums and go back
    by joins, so no task holds a marginal's cells.
    """
    keys = [f"_{d}" for d in DIMENSIONS]
    rows = kept(described(docs).groupBy(*keys).agg(F.sum("_tokens").alias("tokens")), "cells")
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    made = rows.withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        to = kept(shares(rows, d, mix).select(f"_{d}", (F.col("share") * F.lit(mix.keep * total)).alias(f"to_{d}")), "to")
        made = made.join(small(to), f"_{d}")
    rows = kept(made, "raked")
    few = rows.count() <= FEW
    small_marginals = few or {d: rows.select(f"_{d}").distinct().count() <= FEW for d in DIMENSIONS}
    done = 0
    while done < mix.rounds:
        at_once = min(ROUNDS, mix.rounds - done) if few else 1
        # few cells are one task's work, several rounds in a row
        new = rows.coalesce(1) if few else rows
        for _ in range(at_once):
            new = new.withColumn("_old", F.col("weight"))
            for d in DIMENSIONS:
                if few:
                    new = new.withColumn("_now", F.sum("weight").over(Window.partitionBy(f"_{d}")))
                else:
                    now = new.groupBy(f"_{d}").agg(F.sum("weight").alias("_now"))
                    new = new.join(F.broadcast(now) if small_marginals[d] else now, f"_{d}")
                new = new.withColumn("weight", F.when(F.col("_now") > 0, F.col("weight") * F.col(f"to_{d}") / F.col("_now")).otherwise(0.0)).drop("_now")
            new = new.withColumn("weight", F.least("weight", F.col("tokens").cast("double")))
        new = kept(new, "raked")
        change = new.agg(F.max(F.abs(F.col("weight") - F.col("_old")) / F.greatest("weight", F.lit(1e-9)))).first()[0]
        rows, done = new.drop("_old"), done + at_once
        if change is None or change <= mix.tolerance:
            break
    return rows.select(*keys, "tokens", "weight", *[f"to_{d}" for d in DIMENSIONS])


def report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """dimension, value, tokens, target, raked, residual (raked less target, as a share of the target) of each marginal."""
    made = kept(cells(docs, mix), "cells")
    parts = [
        made.groupBy(F.lit(d).alias("dimension"), F.col(f"_{d}").alias("value")).agg(F.sum("tokens").alias("tokens"), F.first(f"to_{d}").alias("target"), F.sum("weight").alias("raked"))
        for d in DIMENSIONS
    ]
    whole = parts[0].union(parts[1]).union(parts[2])
    return whole.withColumn("residual", F.when(F.col("target") > 0, F.col("raked") / F.col("target") - 1).otherwise(0.0))


def drawn(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs with _source, _lang, _topic, _tokens, _prob and _sampled."""
    made = kept(cells(docs, mix), "cells")
    prob = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    made = made.select("_source", "_lang", "_topic", prob.alias("_prob"))
    found = described(docs).join(small(made), [f"_{d}" for d in DIMENSIONS], "left")
    sign = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{mix.salt}")).cast("binary"))
    share = F.conv(F.substring(sign, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    return found.withColumn("_sampled", share < F.col("_prob"))


def sampled(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of docs that the draw keeps, with their columns."""
    return drawn(docs, mix).where("_sampled").select(*docs.columns)


def mixture(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, prob, sampled of each row."""
    return drawn(docs.select("doc_id", "text", "source", "lang"), mix).select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"), F.round("_prob", 6).alias("prob"), F.col("_sampled").alias("sampled"),
    )


def sql(mix: Mix = Mix()) -> str:
    """mixture() in DuckDB's SQL."""
    parts = [
        f"""described as (select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang,
            case when (length(body) - length(replace(body, '|', ''))) * 50 >= n then 'tabular' when contains(body, '@') then 'contact'
                when contains(lower(body), 'license') or contains(lower(body), 'copyright') then 'legal' when (length(body) - length(translate(body, '0123456789', ''))) * 5 >= n then 'numbers'
                when (length(body) - length(replace(body, chr(10), ''))) * 40 >= n then 'list' when n < 1000 then 'short prose' else 'long prose' end as topic,
            len(regexp_extract_all(body, '{WORD}')) as n_tokens from (select *, coalesce(text, '') as body, greatest(length(coalesce(text, '')), 1) as n from documents))""",
        "cells as (select source, lang, topic, sum(n_tokens) as tokens from described group by all)",
    ]
    columns = []
    for d in DIMENSIONS:
        own = f"select {d}, sum(tokens)::double as own from cells group by {d}"
        named = mix.of(d)
        given = f"case when own > 0 then case {d} {' '.join(f"when '{k}' then {x!r}::double" for k, x in named.items())} end end" if named else ""
        raised = f"coalesce({given}, own * (1 - (select coalesce(sum({given}), 0) from ({own}))) / nullif((select sum(case when {given} is null then own end) from ({own})), 0), 0)" if named else f"case when own > 0 then pow(own, {getattr(mix, d)}) else 0 end"
        parts.append(f"own_{d} as (select {d}, {raised} as raised from ({own}))")
        columns.append(f"(select raised from own_{d} o where o.{d} = cells.{d}) / (select sum(raised) from own_{d}) * {mix.keep} * (select sum(tokens) from cells) as to_{d}")
    parts.append(f"w0 as materialized (select *, tokens::double as weight, {', '.join(columns)} from cells)")
    n = 0
    for _ in range(mix.rounds):
        for d in DIMENSIONS:
            now = f"sum(weight) over (partition by {d})"
            parts.append(f"w{n + 1} as materialized (select * replace (case when {now} > 0 then weight * to_{d} / {now} else 0 end as weight) from w{n})")
            n += 1
        parts.append(f"w{n + 1} as materialized (select * replace (least(weight, tokens::double) as weight) from w{n})")
        n += 1
    return f"""with {', '.join(parts)}
        select doc_id, source, lang, topic, n_tokens, round(prob, 6) as prob, share < prob as sampled
        from (select d.*, case when w.tokens > 0 then w.weight / w.tokens else 0 end as prob,
            ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{mix.salt}'), 1, 13))::bigint / pow(2, 52) as share
            from described d join w{n} w using (source, lang, topic))"""
