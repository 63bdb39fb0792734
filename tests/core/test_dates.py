from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates

CASES = [
    ("start", "Лекция 1 июня в 18.30 в зале", "2026-05-30", datetime(2026, 6, 1, 18, 30)),
    ("start", "Показ пройдет 3 августа.", "2026-06-24", datetime(2026, 8, 3)),
    ("start", "19 и 20 июня в 17:00 концерт", "2026-06-10", datetime(2026, 6, 19, 17)),
    ("start", "Ждем 2 января в 12:00", "2025-12-30", datetime(2026, 1, 2, 12)),
    ("start", "Скоро пройдет встреча.", "2026-01-01", None),
    ("start", "31 июня в 10:00", "2026-01-01", None),
    ("deadline", "подать заявку можно до 23 июня", "2025-06-03", datetime(2025, 6, 23)),
    ("listed", "19 и 20 июня в 17:00 встречи", "2026-06-10", [datetime(2026, 6, 19, 17), datetime(2026, 6, 20, 17)]),
    ("listed", "3, 4, 5 января, начало 14:00 - 17:00", "2025-12-30", [datetime(2026, 1, d, 14) for d in (3, 4, 5)]),
    ("end", "21–22 августа. Начало 21 августа в 18:00", "2026-08-21", date(2026, 8, 22)),
    ("end", "с 21 по 23 августа", "2026-08-21", date(2026, 8, 23)),
    ("end", "31 августа — 1 сентября", "2026-08-31", date(2026, 9, 1)),
    ("end", "с 30 декабря по 2 января", "2025-12-30", date(2026, 1, 2)),
    ("end", "21 и 25 августа", "2026-08-21", None),
]


@pytest.mark.parametrize("kind,said,day,want", CASES)
def test_russian_dates(spark, kind, said, day, want):
    df = spark.createDataFrame([(said, date.fromisoformat(day))], "t string, d date")
    t, d, today = F.col("t"), F.col("d"), F.lit("2026-01-01").cast("date")
    made = {"start": dates.start_in(t, d, today), "deadline": dates.deadline_in(t, d, today), "listed": dates.listed_starts(t, d, today), "end": dates.range_end(t, d)}
    assert df.select(made[kind]).first()[0] == want


def test_local_times_and_instants(spark):
    df = spark.createDataFrame([("2026-06-05T18:00:00+04:00",), ("2026-06-05T18:00:00Z",), ("2026-06-05",), ("soon",)], "t string")
    assert [r[0] for r in df.select(dates.local_time(F.col("t"))).collect()] == [datetime(2026, 6, 5, 18), datetime(2026, 6, 5, 18), datetime(2026, 6, 5), None]
    assert [r[0] for r in df.select(dates.published_at_utc(F.col("t")).cast("string")).collect()] == ["2026-06-05 14:00:00", "2026-06-05 18:00:00", "2026-06-05 00:00:00", None]


def test_iso_stamps_are_read_as_by_the_standard_library(spark):
    given = ["2026-06-05", "20260605", "2026-W23-5", "2026W235", "2026-W23", "2026-W54-1", "2020-W53-7", "2026-06-05T18", "2026-06-05T18:30", "20260605T1830", "20260605T183059", "2026-06-05 18:30:59.25", "2026-06-05T18:30:59,5", "2026-W01-1T10:00", "2026-13-01", "2026-02-30", "2026-6-5", "2026", "junk", "2026-06-05T24:61"]
    stamps = given + [g + z for g in given[7:13] for z in ("Z", "+03:00", "-05")]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in stamps], "t string").select(dates.local_time(F.col("t"))).collect()]

    def read(t):
        try:
            return datetime.fromisoformat(t).replace(tzinfo=None)
        except ValueError:
            return None

    assert dict(zip(stamps, got, strict=True)) == {t: read(t) for t in stamps}
