"""Column functions for Russian dates in texts. All times are local wall times without zone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schemas import MONTH_FORMS, MONTHS

M = "(?:" + "|".join(sorted(MONTHS, key=len, reverse=True)) + ")"
#: Up to 80 signs that don't reach over another date.
GAP = rf"(?:(?!\b\d{{1,2}}\s*{M}\b).){{0,80}}?"
TIME = r"\b(\d{1,2})[:.](\d{2})\b"
DATE = rf"(?iuU)\b(\d{{1,2}})\s*({M})\b"
DATE_TIME = rf"(?iuUs)\b(\d{{1,2}})\s*({M})\b{GAP}{TIME}"
SPAN_TIME = rf"(?iuUs)\b(\d{{1,2}})\s*(?:и|[-–—])\s*\d{{1,2}}\s*({M})\b{GAP}{TIME}"
LISTED_TIME = rf"(?iuUs)\b(\d{{1,2}}(?:\s*(?:,|и)\s*\d{{1,2}})+)\s*({M})\b{GAP}{TIME}"
DEADLINE = rf"(?iuU)\b(?:до|дедлайн:?)\s+(\d{{1,2}})\s*({M})\b"
DASHED = rf"(?iuU)\b(\d{{1,2}})\s*[-–—]\s*(\d{{1,2}})\s*({M})\b"
FROM_TO = rf"(?iuU)\bс\s+(\d{{1,2}})(?:\s*({M}))?\s+по\s+(\d{{1,2}})\s*({M})\b"
OVER_MONTHS = rf"(?iuU)\b(\d{{1,2}})\s*({M})\s*[-–—]\s*(\d{{1,2}})\s*({M})\b"
ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?)?)?$"


#: The first three letters of each month, with май for both its forms.
STEMS = "".join(a[:3].replace("мая", "май") for a, _ in MONTH_FORMS)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, where an expression names it several times."""
    return F.transform(F.array(value), use)[0]


def month(name: Column) -> Column:
    """The number of a month's form; null for null."""
    stem = F.replace(F.substring(F.lower(name), 1, 3), F.lit("мая"), F.lit("май"))
    return ((F.instr(F.lit(STEMS), stem) + 2) / 3).cast("int")


def published_date(published_at: Column) -> Column:
    """The date in the stamp's own zone."""
    return F.try_to_date(F.substring(published_at, 1, 10), "yyyy-MM-dd")


def published_at_utc(published_at: Column) -> Column:
    """The instant; a stamp without zone counts as UTC."""
    with_zone = F.when(published_at.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), published_at).otherwise(F.concat(published_at, F.lit("Z")))
    return F.try_to_timestamp(F.when(published_at.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), with_zone).otherwise(F.concat(published_at, F.lit("T00:00:00Z"))))


def resolved(day: Column, month_no: Column, hour: Column, minute: Column, published: Column, today: Column) -> Column:
    """The date in the year of publication, or the next if that is before it; in today's year if there is none. Null if no such date."""
    at = lambda year: F.try_make_timestamp_ntz(year, month_no, day, hour, minute, F.lit(0))
    own = at(F.year(F.coalesce(published, today)))
    return let(own, lambda x: F.when(x.cast("date") < published, at(F.year(published) + 1)).otherwise(x))


def _part(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def start_in(text: Column, published: Column, today: Column) -> Column:
    """The start that a text names: the first of two dates with a time, a date with a time, a date alone (midnight). The first
    pattern that matches decides, even if what it matches is no date."""
    out = F.lit(None).cast("timestamp_ntz")
    for pattern, timed in reversed(((SPAN_TIME, True), (DATE_TIME, True), (DATE, False))):
        p = lambda k, pattern=pattern: _part(text, pattern, k)
        hour, minute = (p(3).cast("int"), p(4).cast("int")) if timed else (F.lit(0), F.lit(0))
        out = F.when(text.rlike(pattern), resolved(p(1).cast("int"), month(p(2)), hour, minute, published, today)).otherwise(out)
    # each month has Cyrillic letters
    return F.when(text.rlike("[а-яёА-ЯЁ]"), out)


def deadline_in(text: Column, published: Column, today: Column) -> Column:
    return resolved(_part(text, DEADLINE, 1).cast("int"), month(_part(text, DEADLINE, 2)), F.lit(0), F.lit(0), published, today)


def listed_starts(text: Column, published: Column, today: Column) -> Column:
    """A start for each day of a list with one month and time; days that don't exist are left out."""
    p = lambda k: _part(text, LISTED_TIME, k)
    days = F.regexp_extract_all(F.coalesce(p(1), F.lit("")), F.lit(r"(\d{1,2})"), F.lit(1))
    return F.array_compact(F.transform(days, lambda d: resolved(d.cast("int"), month(p(2)), p(3).cast("int"), p(4).cast("int"), published, today)))


def _all(text: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(k))


def _end_of(start: Column, wraps: bool):
    """The end date of a match (first day, first month if written, last day, last month) that begins on the start's day."""

    def end(x: Column) -> Column:
        d1, d2, m2 = x["0"].cast("int"), x["2"].cast("int"), month(x["3"])
        m1 = F.coalesce(month(F.nullif(x["1"], F.lit(""))), m2)
        year = F.year(start) + (F.when(m2 * 100 + d2 < m1 * 100 + d1, 1).otherwise(0) if wraps else F.lit(0))
        made = F.try_make_timestamp_ntz(year, m2, d2, F.lit(0), F.lit(0), F.lit(0)).cast("date")
        return F.when((F.dayofmonth(start) == d1) & (F.month(start) == m1) & (made > start.cast("date")), made)

    return end


def range_end(text: Column, start: Column) -> Column:
    """The later end date of a range in the text whose first day is the start's; ranges over months come first, then from-to, then
    with a dash. All places of each pattern are tried."""
    tried = []
    for pattern, parts in ((OVER_MONTHS, (1, 2, 3, 4)), (FROM_TO, (1, 2, 3, 4)), (DASHED, (1, 3, 2, 3))):
        zipped = F.arrays_zip(*[_all(text, pattern, k).alias(f"p{j}") for j, k in enumerate(parts)])
        named = F.transform(zipped, lambda x: F.struct(*[x[f"p{j}"].alias(str(j)) for j in range(4)]))
        tried.append(F.try_element_at(F.array_compact(F.transform(named, _end_of(start, pattern != DASHED))), F.lit(1)))
    return F.coalesce(*tried)


def _extended(c: Column) -> Column:
    """ISO stamps in their basic form or by weeks, as calendar dates with hyphens and colons."""
    c = F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    c = F.regexp_replace(c, r"^([^T ]{10}[T ])(\d{2})(\d{2})(?:(\d{2}(?:[.,]\d+)?))?$", "$1$2:$3:$4")
    c = F.regexp_replace(F.regexp_replace(c, ":$", ""), r"(:\d{2}),(\d+)$", "$1.$2")
    part = lambda k: F.regexp_extract(c, r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?(?=$|[T ])", k)
    fourth = F.make_date(part(1).try_cast("int"), F.lit(1), F.lit(4))
    week, day = part(2).try_cast("int"), F.coalesce(part(3).try_cast("int"), F.lit(1))
    # the week of 4 January is the first; the last one is that of 28 December
    monday = F.date_sub(fourth, F.weekday(fourth))
    last = F.weekofyear(F.make_date(part(1).try_cast("int"), F.lit(12), F.lit(28)))
    dated = F.date_add(monday, (week - 1) * 7 + day - 1).cast("string")
    rest = F.regexp_extract(c, "^[^T ]*(.*)$", 1)
    return F.when(part(1) == "", c).when((week >= 1) & (week <= last), F.concat(dated, rest))


def local_time(c: Column) -> Column:
    """An ISO stamp's wall time, whatever its offset; null if it is none."""
    bare = F.regexp_replace(c, r"([T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?)(?:Z|[+-]\d{2}(?::?\d{2})?)$", "$1")
    whole = _extended(bare)
    return F.when(whole.rlike(ISO), whole.try_cast("timestamp_ntz"))


def unix_to_iso(c: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def span(start: Column, end: Column) -> Column:
    """First and last day; null without a start. An end before the start counts as the start."""
    return F.when(start.isNotNull(), F.struct(start.cast("date").alias("first"), F.greatest(start.cast("date"), F.coalesce(end, start).cast("date")).alias("last")))


def spans_related(a: Column, b: Column) -> Column:
    """Whether two spans overlap or lie at most a day apart."""
    return F.coalesce((a["first"] <= F.date_add(b["last"], 1)) & (b["first"] <= F.date_add(a["last"], 1)), F.lit(False))


def close(a: Column, b: Column, days: int = 3) -> Column:
    return F.coalesce(F.abs(F.date_diff(a.cast("date"), b.cast("date"))) <= days, F.lit(False))


def date_tokens(text: Column) -> Column:
    """day.month of each date, the day as written."""
    text = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.zip_with(_all(text, DATE, 1), _all(text, DATE, 2), lambda d, m: F.concat(d, F.lit("."), month(m).cast("string"))))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
