"""Bottom-k sketches of word shingles, in DataFrame and SQL functions alone.

A text's sketch is the k least 64-bit hashes of its distinct shingles, sorted. Sketches merge (the k least of both), so parts of
a corpus can be sketched apart. Two sketches estimate resemblance (of the k least hashes of both, the share that both hold),
containment (how much of the first lies in the second) and a set's size. Up to k shingles all of these are exact.

Shingle hashes come from word hashes by doubling: hashes of two words, of four, then of five, so that no shingle's text is built.
Words are runs of other signs than ASCII white space, in lower case; a text of fewer words than a shingle is one shingle, one
without words has an empty sketch, which resembles empty ones fully and others not at all. Null text counts as empty. Repeated rows
are sketched each, and rows of one id follow each other by text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import kept, small, with_columns

K = 64
#: Documents dealt together, about; cells of more than CROWDED of them are split.
RUN, CROWDED = 1024, 8192
#: Splits of crowded cells; what is crowded then agrees in id and in the first seven bytes.
LEVELS = 6
SPACE_SIGNS = " \t\n\x0b\f\r"


def sketched(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """df with the sketch (array of longs) of shingles of five words of a text column."""
    words, h = f"_{out}_words", f"_{out}_h"
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACE_SIGNS))
    df = df.withColumn(words, trimmed)
    df = df.withColumn(h, F.when(F.col(words) == "", F.array().cast("array<string>")).otherwise(F.split(words, r"[\x20\x09-\x0D]+")))
    df = df.withColumn(h, F.transform(h, lambda w: F.xxhash64(w)))
    combine = lambda a, b: F.xxhash64(a, b)
    n = F.size(h)
    at_least = lambda x: F.greatest(x, F.lit(0))
    df = df.withColumn(f"{h}2", F.zip_with(F.slice(h, 1, at_least(n - 1)), F.slice(h, 2, at_least(n - 1)), combine))
    df = df.withColumn(f"{h}4", F.zip_with(F.slice(f"{h}2", 1, at_least(n - 3)), F.slice(f"{h}2", 3, at_least(n - 3)), combine))
    five = F.zip_with(F.slice(f"{h}4", 1, at_least(n - 4)), F.slice(h, 5, at_least(n - 4)), combine)
    found = F.when(n >= 5, five).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(out, F.slice(F.sort_array(F.array_distinct(found)), 1, k))
    return df.drop(words, h, f"{h}2", f"{h}4")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both sets together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_groups(df: DataFrame, keys: list[str], sketch: str, k: int = K, parts: int = 64) -> DataFrame:
    """The sketch of each group's union: first within parts of a group, then over the parts, so that no task gets a large group."""
    fold = lambda c: F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k).alias(sketch)
    few = df.select(*keys, sketch, F.pmod(F.xxhash64(sketch), F.lit(parts)).alias("_part")).distinct()
    return few.groupBy(*keys, "_part").agg(fold(sketch)).groupBy(*keys).agg(fold(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union that both sets hold; 1 for two empty sets."""
    least = merged(a, b, k)
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(least, F.array_intersect(a, b))) / F.size(least))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated size of a set; exact below k."""
    span = F.try_element_at(a, F.lit(k)).cast("double") - F.lit(float(-(2**63)))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) * F.lit(float(2**64)) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that the second holds; 1 if the first is empty."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def signs(a: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _cells(keys: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """How rows of _key and _tie (order-preserving numbers) are dealt to cells in order: tables of splits, and the cells by path
    (_c0, _c1, …) with their first _key and _tie.

    The first cells are equal spans of ids, as many as rows ask for; crowded ones are split by spans of their own, by id or, where
    all ids are one, by the tie. So sparse, clustered, null and repeated ids make cells of about RUN rows alike.
    """
    n, low, high = keys.agg(F.count("*"), F.min("_key"), F.max("_key")).first()
    shift = max(0, ((high - low) * RUN // n).bit_length() - 1) if n else 0
    rows, path, splits = keys.withColumn("_c0", F.shiftright("_key", shift)), ["_c0"], [shift]
    for level in range(1, LEVELS + 1):
        ends = rows.groupBy(*path).agg(F.count("*").alias("n"), F.min("_key").alias("a"), F.max("_key").alias("b"), F.min("_tie").alias("x"), F.max("_tie").alias("y"))
        crowded = ends.where((F.col("n") > CROWDED) & ((F.col("a") < F.col("b")) | (F.col("x") < F.col("y"))))
        by_key = F.col("a") < F.col("b")
        width = F.when(by_key, F.col("b").cast("double") - F.col("a").cast("double")).otherwise(F.col("y").cast("double") - F.col("x").cast("double")) * RUN / F.col("n")
        table = kept(crowded.select(*path, by_key.alias("by_key"), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(width, F.lit(1.0))))).cast("int").alias("shift")), "splits")
        if table.isEmpty():
            break
        splits.append(table)
        rows = _split(rows, table, path, level)
        path = [*path, f"_c{level}"]
    return splits, kept(rows.groupBy(*path).agg(F.min(F.struct("_key", "_tie")).alias("first")), "cells")


def _split(df: DataFrame, table: DataFrame, path: list[str], level: int) -> DataFrame:
    table = table.select(*[F.col(c).alias(f"_s{c}") for c in path], "by_key", "shift")
    on = F.lit(True)
    for c in path:
        on = on & F.col(c).eqNullSafe(F.col(f"_s{c}"))
    return df.join(small(table), on, "left").withColumn(f"_c{level}", F.expr("shiftright(if(by_key, _key, _tie), shift)")).drop(*[f"_s{c}" for c in path], "by_key", "shift")


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with next_<column> of the row that follows by doc_id (ties by text), the first row following the last.

    Rows are dealt to cells of neighbouring ids (see _cells) and ordered within these, so that no task sees all rows. A cell's last
    row looks ahead to the first row of the next cell, which is delivered to the cell before as well. Which these are comes from
    numbers alone; cells are a thousandth of the rows, and a row of numbers each, so one task orders them. Null ids come first, as
    the least number.
    """
    tie = F.conv(F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    df = df.withColumns({"_key": F.coalesce("doc_id", F.lit(-(2**63))), "_tie": F.coalesce(tie, F.lit(0))})
    splits, cells = _cells(df.select("_key", "_tie"))
    path = [f"_c{k}" for k in range(len(splits))]
    df = df.withColumn("_c0", F.shiftright("_key", splits[0]))
    for k, table in enumerate(splits[1:], 1):
        df = _split(df, table, path[:k], k)
    along = Window.orderBy("first._key", "first._tie")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(*path)
    before = kept(cells.select("first", F.coalesce(F.lag(own).over(along), F.last(own).over(whole)).alias("_before")), "before")
    firsts = before.select(F.col("first._key").alias("_key"), F.col("first._tie").alias("_tie"), "_before")
    joined = df.join(small(firsts), ["_key", "_tie"], "left")
    dealt = F.array_compact(F.array(F.struct(own.alias("cell"), F.lit(False).alias("ahead")), F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("cell"), F.lit(True).alias("ahead")))))
    dealt = joined.withColumn("_deal", F.explode(dealt))
    order = Window.partitionBy("_deal.cell").orderBy("_deal.ahead", "_key", "text")
    led = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where("not _deal.ahead").drop("_key", "_tie", "_before", "_deal", *path)


def compared(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and more estimates.

    The edited text has its last quarter (rounded down, in code points) replaced by as many of the first of the next document.
    Each text crosses one shuffle. An empty table gives no rows; repeated rows follow each other.
    """
    docs = with_columns(docs, {"doc_id": "long", "text": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    docs = with_next(sketched(docs, "text", "sketch", k), ["text", "sketch"])
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    docs = sketched(docs, "edited", "edited_sketch", k)
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), signs(a).alias("fingerprint"), signs(b).alias("edited_fingerprint"),
        resemblance(a, b, k).alias("near_edited"), resemblance(a, c, k).alias("near_next"), containment(a, b, k).alias("contained_in_edited"), distinct_shingles(a, k).alias("shingles"),
    )
