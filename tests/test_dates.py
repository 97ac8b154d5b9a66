from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from eventboard.functions import dates as dt
from eventboard.functions import predicates as pr

L = F.lit


def at(text):
    return datetime.fromisoformat(text) if text else None


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("form", "text", "expected"),
    [
        (dt.month_comma, "February 3, 2026", "2026-02-03"),
        (dt.month_comma, "Version 12, 2024", None),
        (dt.month_comma, "OnlineFebruary 3, 2026Crime", "2026-02-03"),
        (dt.month_comma, "Feb 3 2026", None),
        (dt.month_comma, "February 30, 2026", None),
        (dt.month_loose, "Feb 3 2026", "2026-02-03"),
        (dt.month_loose, "Wednesday, Jan 10, 2024", "2024-01-10"),
        (dt.month_name, "on MARCH 5 2026", "2026-03-05"),
        (dt.month_name, "on Marc 5 2026", None),
        (dt.month_abbrev, "Sept 3, 2026", "2026-09-03"),
        (dt.month_strict, "Marchember 3, 2026", None),
        (dt.iso_date, "x 2026/01/06 y", "2026-01-06"),
        (dt.dotted_date, "2026.01.06", "2026-01-06"),
        (dt.slash_date, "1/7/2026", "2026-01-07"),
        (dt.slash_date, "13/7/2026", None),
        (dt.iso_or_month, "Jan 2, 2026 and 2020-01-01", "2026-01-02"),
        (dt.ends_on, "Ends on March 5, 2026 ET", "2026-03-05"),
        (dt.rfc822, "Thu, 29 Jan 2026 22:00:00 +0000", "2026-01-29 22:00"),
        (dt.rfc822, "29 Jan 2026 22:00 GMT", "2026-01-29 22:00"),
        (dt.rfc822, "Thu, 29 Jan 2026 22:00:00 -0130", "2026-01-29 23:30"),
        (dt.rfc822, "nonsense", None),
        (dt.any_date, "2026-01-31T21:55:58.697Z", "2026-01-31 21:55:58.697"),
        (dt.any_date, "2026-02-03T14:00:00+02:00", "2026-02-03 12:00"),
        (dt.any_date, "2026-02-03", "2026-02-03"),
        (dt.any_date, "2026-02-31", None),
        (dt.any_date, "not a date", None),
    ],
)
def test_forms(value, form, text, expected):
    assert value(lambda: form(L(text))) == at(expected)


def test_zone_less_time_is_read_in_the_rule_zone(value):
    assert value(lambda: dt.any_date(L("2026-01-01T09:00"), "Asia/Tokyo")) == at("2026-01-01")
    assert value(lambda: dt.any_date(L("2026-01-01T09:00Z"), "Asia/Tokyo")) == at("2026-01-01 09:00")
    assert value(lambda: dt.any_date(L("February 3, 2026"), "Asia/Tokyo")) == at("2026-02-02 15:00")
    assert value(lambda: dt.any_date(L("February 3, 2026"), L(None).cast("string"))) == at("2026-02-03")


def test_end_time_needs_a_future_plausible_instant(value):
    text = "End Time: 2026/03/01 14:59:59"
    assert value(lambda: dt.end_time(L(text), "2026-02-01")) == at("2026-03-01 14:59:59")
    assert value(lambda: dt.end_time(L(text), "2026-04-01")) is None
    assert value(lambda: dt.end_time(L(text), "2023-04-01")) is None
    past_then_next = "End Time: 2026/01/01 00:00:00 until 2026/05/01 10:00:00"
    assert value(lambda: dt.end_time(L(past_then_next), "2026-02-01")) == at("2026-05-01 10:00")
    assert value(lambda: dt.end_time(L("End Time: 2026-05-01 10:00"), "2026-02-01")) == at("2026-05-01 10:00")


def test_season_zone_is_a_label_unless_asked(value):
    text = "Ends on March 5, 2026 ET"
    assert value(lambda: dt.ends_on_zone(L(text))) == "America/New_York"
    assert value(lambda: dt.ends_on_zone(L("Ends: March 5, 2026"))) is None
    assert value(lambda: dt.ends_on(L(text), apply_tz=True)) == at("2026-03-05 05:00")


def test_season_fields(spark):
    df = spark.createDataFrame([(at("2026-03-05"), None)], "event_at timestamp_ntz, tz_label string")
    row = dt.season_fields(df).first()
    assert row.current_season_ends == date(2026, 3, 5)
    assert row.next_season_estimate == date(2026, 3, 6)
    assert row.next_season_estimate_friendly == "March 6, 2026"


@pytest.mark.parametrize(
    ("text", "anchor", "expected"),
    [
        ("2 weeks ago", "2026-02-15 12:00", "2026-02-01 12:00"),
        ("1 month ago", "2026-03-31 01:00", "2026-02-28 01:00"),
        ("posted 5 Hours AGO", "2026-02-15 12:00", "2026-02-15 07:00"),
        ("3 years ago", "2026-02-15 12:00", None),
    ],
)
def test_relative(value, text, anchor, expected):
    assert value(lambda: dt.relative(L(text), anchor)) == at(expected)


def test_yearless_and_noise(value):
    assert value(lambda: dt.yearless(L("January 7"), "2026-02-01")) == "January 7, 2026"
    assert value(lambda: dt.yearless(L("January 7, 2025"), "2026-02-01")) == "January 7, 2025"
    assert value(lambda: dt.strip_noise_prefix(L("Patch Notes x PATCH NOTES"))) == "x PATCH NOTES"


@pytest.mark.parametrize(
    ("number", "text", "expected"),
    [
        (1700000000.0, None, "2023-11-14 22:13:20"),
        (None, "2026-01-31T21:55:58.697Z", "2026-01-31 21:55:58.697"),
        (0.0, None, None),
        (None, None, None),
    ],
)
def test_epoch_or_string(value, number, text, expected):
    assert value(lambda: dt.epoch_or_string(L(number).cast("double"), L(text).cast("string"))) == at(expected)


@pytest.mark.parametrize(
    ("now", "mode", "expected"),
    [
        ("2026-02-04 21:37:12", "strict", "2026-02-05 10:00"),
        ("2026-02-05 09:59:59", "strict", "2026-02-05 10:00"),
        ("2026-02-05 10:00:00", "strict", "2026-02-12 10:00"),
        ("2026-02-05 10:00:30", "strict", "2026-02-12 10:00"),
        ("2026-02-05 10:00:30", "minute", "2026-02-05 10:00"),
        ("2026-02-05 10:01:00", "minute", "2026-02-12 10:00"),
        ("2026-02-08 23:00:00", "strict", "2026-02-12 10:00"),
    ],
)
def test_next_weekly(value, now, mode, expected):
    assert value(lambda: dt.next_weekly(ntz(now), boundary=mode)) == at(expected)


def test_weekly_slot_is_always_within_the_coming_week(spark):
    hours = spark.range(2000).select(
        (ntz("2026-01-01 00:00:07") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts")
    )
    bad = hours.withColumn("slot", dt.next_weekly(F.col("ts"))).filter(
        (F.col("slot") <= F.col("ts"))
        | (F.col("slot") > F.col("ts") + F.make_dt_interval(days=F.lit(7)))
        | (F.weekday("slot") != 3)
        | (F.hour("slot") != 10)
    )
    assert bad.count() == 0


def test_guards(value):
    assert value(lambda: pr.plausible(ntz("2023-12-31"), "2026-02-04")) is False
    assert value(lambda: pr.plausible(ntz("2024-02-04"), "2026-02-04")) is True
    assert value(lambda: pr.upcoming(ntz("2026-02-04"), "2026-02-04 21:00")) is True
    assert value(lambda: pr.upcoming(ntz("2026-02-04"), "2026-02-04 21:00", "instant")) is False


@pytest.mark.parametrize(
    ("status", "mode", "expected"),
    [
        (200, "http", None), (403, "http", "blocked"), (429, "http", "blocked"), (404, "http", "unavailable"),
        (503, "http", "unavailable"), (0, "http", "unavailable"), (0, "browser", "blocked"),
    ],
)
def test_failure_type(value, status, mode, expected):
    assert value(lambda: pr.failure_type(L(status), L(mode))) == expected


def test_extract_dates_lists_every_match(spark):
    df = spark.createDataFrame([(1, "May 1, 2026 or 2026.01.06, then June 2, 2026")], "id int, text string")
    rows = dt.extract_dates(df, "text", ["month_comma", "dotted_date"], ["id"]).orderBy("tier", "pos").collect()
    assert [(r.tier, r.pos, r.event_at) for r in rows] == [
        (1, 0, at("2026-05-01")), (1, 1, at("2026-06-02")), (2, 0, at("2026-01-06")),
    ]


@pytest.mark.parametrize(
    ("text", "utc", "tokyo"),
    [
        ("Feb 3, 2026 5:30 PM", "2026-02-03 17:30", "2026-02-03 08:30"),
        ("February 3, 2026 17:30:00", "2026-02-03 17:30", "2026-02-03 08:30"),
        ("2026-02-03 10:00 AM", "2026-02-03 10:00", "2026-02-03 01:00"),
        ("2/3/2026, 12:05 am", "2026-02-03 00:05", "2026-02-02 15:05"),
        ("Tue Feb 03 2026 10:00:00 GMT+0200 (Eastern European Time)", "2026-02-03 08:00", "2026-02-03 08:00"),
        ("Feb 3, 2026 10:00 -05:00", "2026-02-03 15:00", "2026-02-03 15:00"),
        ("3 February 2026", "2026-02-03 00:00", "2026-02-02 15:00"),
        ("3 Feb 2026 12:00 PM UTC", "2026-02-03 12:00", "2026-02-03 12:00"),
        ("Posted on Feb 3, 2026 by x", "2026-02-03 00:00", "2026-02-02 15:00"),
        ("Feb 3, 2026 13:00 PM", None, None),
        ("Feb 3, 2026 25:00", None, None),
        ("Foo 3, 2026 10:00", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_dates_with_a_clock(spark, text, utc, tokyo):
    df = spark.createDataFrame([(text,)], "s string")
    row = df.select(dt.any_date(F.col("s")).alias("u"), dt.any_date(F.col("s"), "Asia/Tokyo").alias("t")).first()
    assert [v and v.strftime("%Y-%m-%d %H:%M") for v in (row.u, row.t)] == [utc, tokyo]
