"""Row types, value domains and word lists of posts and events."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"STRING": T.StringType(), "BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP_NTZ": T.TimestampNTZType(), "ARRAY<STRING>": T.ArrayType(T.StringType())}


def _struct(columns: str) -> T.StructType:
    """As StructType.fromDDL, which needs a session that isn't there yet on import."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


EVENT_TYPES = tuple(
    "EducationEvent BusinessEvent ChildrensEvent ComedyEvent CompetitionEvent CourseInstance DanceEvent DeliveryEvent ExhibitionEvent Festival "
    "FoodEvent Hackathon LiteraryEvent MusicEvent PublicationEvent SaleEvent ScreeningEvent SocialEvent SportsEvent TheaterEvent VisualArtsEvent".split()
)
ATTENDANCE_TYPES = tuple(f"{x}EventAttendanceMode" for x in ("Offline", "Online", "Mixed"))
ROLES = tuple("Organizer CoOrganizer Speaker Expert Host Participant Spectator Volunteer Partner Sponsor Media Guest".split())
INDUSTRIES = tuple("Art FolkCrafts PerformingArts FilmAndAnimation Photography Design Fashion Architecture TelevisionAndRadio Advertising Publishing ITAndVideoGames Tourism".split())
SKIP_REASONS = ("not_event_announcement", "past_event_report", "vacancy", "safety_instruction", "general_news", "media_recap")
STATUSES = ("extracted", "skipped", "invalid", "llm_error")
#: Genitive and nominative of each month, in order.
MONTH_FORMS = (
    ("января", "январь"), ("февраля", "февраль"), ("марта", "март"), ("апреля", "апрель"), ("мая", "май"), ("июня", "июнь"),
    ("июля", "июль"), ("августа", "август"), ("сентября", "сентябрь"), ("октября", "октябрь"), ("ноября", "ноябрь"), ("декабря", "декабрь"),
)
MONTHS = {form: k for k, forms in enumerate(MONTH_FORMS, 1) for form in forms}
TITLE_STOPWORDS = tuple("в на и для по с со о об мероприятие событие фестиваль концерт спектакль конкурс кинопоказ вечер".split())

POST = _struct("post_pos BIGINT, text STRING, raw_text STRING, source_name STRING, source_url STRING, published_at STRING, external_id STRING, is_pinned BOOLEAN")
EVENT = _struct(
    "title STRING, description STRING, start_at TIMESTAMP_NTZ, end_at TIMESTAMP_NTZ, timezone STRING, city STRING, venue_name STRING, address STRING, "
    "event_type STRING, attendance_type STRING, language STRING, source_name STRING, source_url STRING, raw_text STRING, "
    "relevant_roles ARRAY<STRING>, industries ARRAY<STRING>, skills ARRAY<STRING>, price_text STRING, target_audience_text STRING"
)
ERRORS = T.ArrayType(_struct("field STRING, code STRING, message STRING"))
#: What merging duplicates left with an event: completed, partial or failed, why, how many versions, and all that it covers.
MERGE = T.StructType().add("status", T.StringType()).add("error", T.StringType()).add("count", T.LongType()).add("sources", T.ArrayType(T.StringType()))
ATTEMPTS = T.ArrayType(T.StructType().add("stage", T.StringType()).add("model", T.StringType()).add("success", T.BooleanType()).add("error", T.StringType()))
#: An outcome row: its place, status and events, then the post's columns, then errors, what it repeats, and metadata (JSON).
OUTCOME = T.StructType().add("outcome_index", T.LongType()).add("status", T.StringType()).add("events", T.ArrayType(EVENT))
for _field in POST.fields[1:]:
    OUTCOME = OUTCOME.add(_field)
OUTCOME = OUTCOME.add("errors", ERRORS).add("duplicate_of_post", T.LongType()).add("metadata", T.StringType()).add("merge", MERGE)
#: What a model returns for an event, before repair: dates are still text.
PAYLOAD = T.StructType([T.StructField(f.name, T.StringType() if f.name in ("start_at", "end_at") else f.dataType) for f in EVENT])


def require(df, schema: T.StructType) -> None:
    """Raise unless df has the schema's columns with its types."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise TypeError(f"columns missing or of another type: {', '.join(wrong)}")
