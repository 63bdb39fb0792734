"""Predicates and repairs over posts and events, as Column functions."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import dates, text
from millrace.functions.dates import let
from millrace.schemas import ATTENDANCE_TYPES, EVENT_TYPES, INDUSTRIES, ROLES

#: The words below, taken from SURVEY A.1, all have Cyrillic letters, and a text without any is told apart at once.
CYRILLIC = "[а-яёА-ЯЁ]"
I = "(?iuU)"
CANCELLED = I + r"\b(?:не\s+состоится|отмен(?:а|яется|или|[её]н[аоы]?))\b"
GIVEAWAY = I + r"\b(?:поздравляем\s+победител|итоги\s+(?:конкурса|розыгрыша)|победител[ья]\b)"
PAST = I + r"\b(?:спасибо\s+(?:всем|каждому)|состоял(?:ась|ось|ись|ся)|прош(?:[её]л|ла|ло)|смотрели|отметили|собрал[аои]?|посетител(?:и|ями)\s+стал[ио]|стал[ао]?\s+(?:для\s+\S+\s+)?(?:опытом|праздником|традицией))\b"
ADMISSION = I + r"\b(?:колледж|университет|поступлени[ея]|подать\s+документы|при[её]м\s+документов|программа\s+(?:высшего\s+)?образования)\b"
APPLICATION = I + r"\b(?:дедлайн|регистрац|при[её]м\s+заявок|(?:подать|пода(?:й|вайте))\s+заявк[уыи]?|голосовани[ея]\s+.+продолжается)\b"
EXPLICIT_END = I + r"\b(?:результаты|итоги|финал|завершение|окончание|до|по)\b"
DURATION = I + r"продолжительность|\b\d+(?:[,.]\d+)?\s*час"


#: Names that the zone database of this machine knows.
ZONES = tuple(sorted(zoneinfo.available_timezones()))


def skip_reason(raw: Column, today: Column) -> Column:
    """Why a post is no announcement, by its words alone; null if it may be one."""
    undated = dates.start_in(raw, F.lit(None).cast("date"), today).isNull()
    return (
        F.when(~raw.rlike(CYRILLIC), F.lit(None).cast("string"))
        .when(raw.rlike(CANCELLED) | raw.rlike(GIVEAWAY), "not_event_announcement")
        .when(raw.rlike(PAST), "past_event_report")
        .when(raw.rlike(ADMISSION) & undated, "not_event_announcement")
    )


def weak_type(c: Column) -> Column:
    return F.coalesce(c, F.lit("unknown")).isin("unknown", "other")


def types_match(a: Column, b: Column) -> Column:
    return ~weak_type(a) & ~weak_type(b) & (a == b)


def types_compatible(a: Column, b: Column) -> Column:
    return weak_type(a) | weak_type(b) | (a == b)


def industries_compatible(a: Column, b: Column) -> Column:
    empty = lambda x: F.coalesce(F.size(x) <= 0, F.lit(True))
    return empty(a) | empty(b) | F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def place_facts() -> dict[str, Column]:
    """What places_similar() reads of an event's columns."""
    return {"address_set": text.tokens(F.col("address")), "venue_set": text.tokens(F.col("venue_name"))}


def places_similar(a: Column, b: Column) -> Column:
    """Whether an address or venue of one event is that of another (structs of place_facts())."""
    return dates.any_of([text.containment(a[x], b[y]) >= 0.8 for x in ("address_set", "venue_set") for y in ("address_set", "venue_set")])


def facts() -> dict[str, Column]:
    """What duplicates() reads of an event's columns and prompt_text, so that each event's words are found once."""
    described = F.coalesce(F.col("description"), F.lit("")) != ""
    return {
        "title_set": F.array_sort(text.tokens(F.col("title"))), "description_set": F.when(described, F.array_sort(text.tokens(F.col("description")))), "date_set": F.array_sort(dates.date_tokens(F.col("prompt_text"))),
        "start_at": F.col("start_at"), "event_type": F.col("event_type"), "industries": F.col("industries"),
    }


def duplicates(a: Column, b: Column) -> Column:
    """Whether two events (structs of facts()) are one by title, date, type, industries and description."""
    title = text.containment(a["title_set"], b["title_set"])
    no_start = a["start_at"].isNull() | b["start_at"].isNull()
    shared_date = (title >= 0.8) & F.arrays_overlap(a["date_set"], b["date_set"])
    dated = dates.close(a["start_at"], b["start_at"]) | (no_start & shared_date)
    typed = types_compatible(a["event_type"], b["event_type"]) | ((title >= 0.8) & F.coalesce(a["start_at"] == b["start_at"], F.lit(False)))
    told = (title >= 0.8) | a["description_set"].isNull() | b["description_set"].isNull() | (text.containment(a["description_set"], b["description_set"]) >= 0.2)
    return (title >= 0.65) & dated & typed & industries_compatible(a["industries"], b["industries"]) & told


def semantic_facts() -> dict[str, Column]:
    """What need_semantic_check() reads of an event's columns and prompt_text."""
    bare = lambda c: text.tokens(text.without_urls(F.col(c)))
    return {
        "title_set": text.tokens(F.col("title")), "description_set": bare("description"), "raw_set": bare("prompt_text"), "urls": text.urls(F.col("description"), F.col("prompt_text")),
        **place_facts(), "event_type": F.col("event_type"), "span": dates.span(F.col("start_at"), F.col("end_at")),
    }


def need_semantic_check(a: Column, b: Column) -> Column:
    """Whether a model should compare two events (structs of semantic_facts()) that the titles alone don't join."""
    title = text.containment(a["title_set"], b["title_set"])
    score = F.greatest(*[text.containment(a[c], b[c]) for c in ("description_set", "raw_set")])
    by_link = F.arrays_overlap(a["urls"], b["urls"]) & ((score >= 0.15) | (a["span"].eqNullSafe(b["span"]) & types_match(a["event_type"], b["event_type"])))
    near = by_link | (score >= 0.45) | (places_similar(a, b) & (score >= 0.25))
    return (title < 0.65) & dates.spans_related(a["span"], b["span"]) & F.coalesce(near, F.lit(False))


def linked_need_check(a: Column, b: Column) -> Column:
    """need_semantic_check() of two events that share a URL, what costs least first."""
    alike = (a["span"] == b["span"]) & types_match(a["event_type"], b["event_type"])
    for c in ("description_set", "raw_set"):
        alike = alike | (text.containment(a[c], b[c]) >= 0.15)
    return dates.spans_related(a["span"], b["span"]) & alike & (text.containment(a["title_set"], b["title_set"]) < 0.65)


def text_facts(raw: Column, published: Column, today: Column) -> dict[str, Column]:
    """What repairs need of a post's text, whatever the payload; to be added as columns first."""
    return {
        "_start": dates.start_in(raw, published, today),
        "_deadline": dates.deadline_in(raw, published, today),
        "_application": raw.rlike(APPLICATION),
        "_inferred": ~raw.rlike(EXPLICIT_END) & raw.rlike(DURATION),
        "_title": text.infer_title(raw),
    }


def repaired_dates(p: Column, raw: Column) -> Column:
    """start_at and end_at after all repairs, in their order; the columns of text_facts() must be there."""
    pair = lambda start, end: F.struct(start.alias("start_at"), end.alias("end_at"))
    deadline = F.col("_deadline")

    def moved(x: Column) -> Column:
        late = F.col("_application") & F.coalesce(x["start_at"].cast("date") == deadline.cast("date"), F.lit(False))
        return pair(F.when(~late, x["start_at"]), F.when(late, F.coalesce(x["end_at"], deadline)).otherwise(x["end_at"]))

    def cut(x: Column) -> Column:
        inferred = F.col("_inferred") & (x["start_at"].cast("date") == x["end_at"].cast("date")) & (x["end_at"] > x["start_at"])
        return pair(x["start_at"], F.when(~F.coalesce(inferred, F.lit(False)), x["end_at"]))

    def ranged(x: Column) -> Column:
        found = F.when(x["end_at"].isNull() & x["start_at"].isNotNull(), dates.range_end(raw, x["start_at"]).cast("timestamp_ntz"))
        return pair(x["start_at"], F.coalesce(x["end_at"], found))

    given = pair(F.when(text.is_missing(p["start_at"]), F.col("_start")).otherwise(dates.local_time(p["start_at"])), dates.local_time(p["end_at"]))
    return let(given, lambda a: let(moved(a), lambda b: let(cut(b), ranged)))


def repaired(p: Column) -> dict[str, Column]:
    """A payload's other columns after repair: title, domains and lists."""
    attendance = F.when(p["attendance_type"].isin(*ATTENDANCE_TYPES), p["attendance_type"]).otherwise("OfflineEventAttendanceMode")
    return {
        "title": F.when(text.is_missing(p["title"]), F.col("_title")).otherwise(text.strip(p["title"])),
        "timezone": F.when(text.strip(p["timezone"]).isin(*ZONES), text.strip(p["timezone"])).otherwise("unknown"),
        "language": F.when(text.is_missing(p["language"]), "ru").otherwise(text.strip(p["language"])),
        "event_type": text.enum_value(p["event_type"], EVENT_TYPES),
        "attendance_type": attendance,
        "relevant_roles": text.in_domain(p["relevant_roles"], ROLES),
        "industries": text.in_domain(p["industries"], INDUSTRIES),
        "skills": text.cleaned_list(p["skills"]),
    } | {c: text.blank_to_null(p[c]) for c in ("description", "city", "venue_name", "address", "price_text", "target_audience_text")}


def errors_of(p: Column, event: Column) -> Column:
    """What is wrong with a repaired event, given the payload it came from."""
    issue = lambda when, field, code, message: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(message).alias("message")))
    bad_date = lambda c: ~text.is_missing(p[c]) & dates.local_time(p[c]).isNull()
    return F.array_compact(
        F.array(
            issue(bad_date("start_at"), "start_at", "invalid_field", "not a date and time"),
            issue(bad_date("end_at"), "end_at", "invalid_field", "not a date and time"),
            issue(event["end_at"] < event["start_at"], "end_at", "invalid_field", "end_at must not be before start_at"),
            issue(text.strip(p["event_type"]) == "", "event_type", "invalid_field", "must not be blank"),
            issue(event["start_at"].isNull() & event["end_at"].isNull() & ~bad_date("start_at") & ~bad_date("end_at"), "start_at", "missing_event_date", "event must have start_at or end_at"),
        )
    )
