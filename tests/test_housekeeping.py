"""Housekeeping, settings, walls and dates: nulls, empty tables and cases that the queries don't hold."""

import datetime

import pytest
from pyspark.sql import functions as F

from plotmill.functions import dates
from plotmill.functions.text import error_class
from plotmill.operators import housekeeping as keep
from plotmill.sources import captures, settings

D = datetime.date


def test_sections(spark):
    s = "section string, line string, goes_not int, file string"
    df = spark.createDataFrame([("Pending", "- [x] a", 1, "f"), ("Processed", "- [ ] b", 1, "f"), ("Notes", "- [x] c", 1, "f"), ("Pending", "text", 1, "f"), ("Pending", None, 1, "f"), (None, "- [x] d", 1, None), ("Pending", "- [ ] e", 1, "f")], s)
    assert [r.goes for r in keep.section_hygiene(df, "section", "line").collect()] == ["Processed", "Pending", "Notes", "Pending", "Pending", None, "Pending"]
    got = {r.file: (r.pending, r.processed, r.done_pending) for r in keep.section_counts(df, "file", "section", "line").collect()}
    assert got == {"f": (2, 1, 1), None: (0, 0, 0)}
    assert keep.section_counts(df.limit(0), "file", "section", "line").count() == 0


def test_retention(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (1, "a")], "id int, url string")
    history = spark.createDataFrame([("a", D(2026, 1, 1), 1), ("a", D(2026, 3, 1), 1), ("b", D(2026, 3, 1), 1), (None, D(2026, 1, 1), 1)], "url string, first_seen date, id int")
    today = F.lit(D(2026, 3, 10))
    got = [(r.id, r.goes, r.since) for r in keep.retain(rows, history, "url", today, 30).orderBy("id").collect()]
    assert got == [(1, "archive", D(2026, 1, 1))] * 2 + [(2, "keep", D(2026, 3, 1)), (3, "backfill", D(2026, 3, 10)), (4, "backfill", D(2026, 3, 10))]
    moved, stay = keep.compact(history, F.col("url") == "a", "first_seen", today, 30)
    assert [(r.url, r.month) for r in moved.collect()] == [("a", "2026-01")] and stay.count() == 3


def test_flags_and_coverage(spark):
    df = spark.createDataFrame([(" viewed ",), (None,), ("REJECTED",), ("",)], "status string")
    got = [(r.decided, r.skipped) for r in keep.with_flags(df, "status", ("Viewed", "Rejected"), ("Rejected",)).collect()]
    assert got == [(True, False), (False, False), (True, True), (False, False)]
    status = lambda rows: spark.createDataFrame(rows, "ok boolean").agg(keep.coverage(F.col("ok")).alias("c")).first().c
    assert [status([(True,)]), status([(True,), (False,)]), status([(False,), (None,)]), status([])] == [0, 1, 2, 3]


def test_settings(spark):
    got = settings.parse_settings("# c\na: 1\nb: 'x # y' # z\nlist:\n  - name: \"n\"\n    enabled: false\n    of: [p, \"q\"]\n  - name: m # c\n    share: 0.5\n    none: ~\nempty:\n")
    assert got == {"a": 1, "b": "x # y", "list": [{"name": "n", "enabled": False, "of": ["p", "q"]}, {"name": "m", "share": 0.5, "none": None}], "empty": []}
    for bad in ("a\n", "a: 1\n- b: 2\n", "l:\n  - a:\n      b: 1\n", "  x: 1\n"):
        with pytest.raises(ValueError, match="line"):
            settings.parse_settings(bad)
    s = settings.searches(spark, {"searches": [{"name": "a", "portal": "p", "enabled": False}, {"name": "b", "portal": "p"}, {"name": "c", "portal": "p"}]})
    rows = spark.createDataFrame([("p", "a"), ("p", "c"), ("q", "c"), (None, None)], "portal string, want string")
    assert [r.search for r in settings.search_for(rows, s, "portal", "want").collect()] == ["b", "c", None, None]
    assert settings.searches(spark, {}).count() == settings.groups(spark, {}).count() == 0
    places = spark.createDataFrame([("In WALDAU",), (None,), ("",)], "place string")
    assert [r.x for r in places.select(settings.in_areas(F.col("place"), ["waldau"]).alias("x")).collect()] == [True, False, False]
    assert [r.x for r in places.select(settings.in_areas(F.col("place"), []).alias("x")).collect()] == [False] * 3


def test_walls_and_failures(spark):
    pages = spark.createDataFrame([("captcha", "", ""), ("", "x" * 3990 + "captcha", ""), ("", "x" * 3995 + "captcha", ""), ("", "x" * 4000 + "captcha", "recaptcha"), (None, None, None), ("", "", "captcha-delivery.com")], "t string, v string, h string")
    assert [r.b for r in pages.select(captures.is_blocked(F.col("t"), F.col("v"), F.col("h")).alias("b")).collect()] == [True, True, False, False, False, True]
    m = spark.createDataFrame([("NET::err_x",), ("forbidden",), ("NAVIGATION",), (None,), ("",)], "m string")
    assert [r.c for r in m.select(error_class(F.col("m")).alias("c")).collect()] == ["bot_defense", "bot_defense", "transient", "error", "error"]


def test_moments_and_available_dates(spark):
    df = spark.createDataFrame([("2026-05-01", "9:30"), ("2026-05-01", None), ("2026-05-01", "99:99"), ("nonsense", "9:30"), (None, None)], "d string, t string")
    got = [r.m and r.m.strftime("%H:%M") for r in df.select(dates.moment(F.col("d"), F.col("t")).alias("m")).collect()]
    assert got == ["09:30", "23:59", "23:59", None, None]
    df = spark.createDataFrame([("Sofort",), ("ab 1.2.2026",), ("2026-02-01",), ("31.02.2026",), ("", ), (None,)], "t string")
    got = [r.a for r in df.select(dates.available_date(F.col("t"), F.lit(D(2026, 7, 1))).alias("a")).collect()]
    assert got == [D(2026, 7, 1), D(2026, 2, 1), D(2026, 2, 1), None, None, None]
