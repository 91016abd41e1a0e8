from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import frame
from wayside.functions import clock, flags, guards, ratios


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, seconds, minute", [
    ("25:15:00", 90_900, 75), ("07:30:05", 27_005, 450), ("7:05:00", 25_500, 425), ("", None, None), ("x:1:2", None, None),
    ("24:00:00", 86_400, 0), ("9999999999:00:00", None, None),
])
def test_schedule_times(spark, text, seconds, minute):
    assert one(spark, clock.gtfs_seconds(F.lit(text))) == seconds
    if seconds is not None:
        assert one(spark, clock.gtfs_minute_key(F.lit(text))) == minute


def test_dates_and_keys(spark):
    assert one(spark, clock.date_key(F.lit(date(2024, 2, 9)))) == 20240209
    assert one(spark, clock.date_from_key(F.lit(20240209))) == date(2024, 2, 9)
    assert one(spark, clock.date_from_key(F.lit(20240231))) is None
    assert one(spark, clock.gtfs_date(F.lit("20240229"))) == date(2024, 2, 29)
    assert one(spark, clock.gtfs_date(F.lit("2024-02-29"))) is None
    assert one(spark, clock.since(F.lit(date(2024, 1, 1)), "2024-01-31", 30)) is True
    assert one(spark, clock.since(F.lit(date(2023, 12, 31)), "2024-01-31", 30)) is False
    assert one(spark, clock.default_day("2024-03-01")) == date(2024, 2, 29)
    early = F.lit("2024-01-02 02:30:00").cast("timestamp_ntz")
    assert one(spark, clock.service_day(early)) == date(2024, 1, 2)
    assert one(spark, clock.service_day(early, 4)) == date(2024, 1, 1)


def test_local_time_across_daylight_saving(spark):
    # 2024-03-10 09:59:59 and 10:00:00 UTC are 01:59:59 and 03:00:00 on the west coast.
    epoch = 1_710_064_799
    assert one(spark, clock.local_time(F.lit(epoch))) == datetime(2024, 3, 10, 1, 59, 59)
    assert one(spark, clock.local_time(F.lit(epoch + 1))) == datetime(2024, 3, 10, 3, 0, 0)
    assert one(spark, clock.utc_time(F.lit(epoch))) == datetime(2024, 3, 10, 9, 59, 59)


def test_wall_clock_arithmetic_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", name)
            a, b = (F.lit(t).cast("timestamp_ntz") for t in ("2024-03-10 01:30:00", "2024-03-10 03:30:00"))
            assert one(spark, clock.elapsed_seconds(a, b)) == 7200
            assert one(spark, clock.scheduled_instant(F.lit(date(2024, 3, 10)), F.lit(90_900))) == datetime(2024, 3, 11, 1, 15)
            assert one(spark, clock.deviation_seconds(F.lit(date(2024, 3, 10)), F.lit(9000), b)) == 3600
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("dev, expected", [
    (-61, (False, True, False)), (-60, (True, False, False)), (300, (True, False, False)), (301, (False, False, True)),
])
def test_punctuality_limits(spark, dev, expected):
    col = F.lit(dev)
    got = spark.range(1).select(flags.on_time(col).alias("a"), flags.early(col).alias("b"), flags.late(col).alias("c")).first()
    assert tuple(got) == expected


@pytest.mark.parametrize("pings, span, expected", [
    (1, 0, None), (3, 20, Decimal("1.0000")), (35, 30, Decimal("1.0000")), (1, 95, Decimal("0.3333")), (5, -10, None),
    (2, 119, Decimal("0.6667")),
])
def test_coverage(spark, pings, span, expected):
    assert one(spark, flags.rt_coverage(F.lit(pings), F.lit(span))) == expected


def test_official_trip(spark):
    df = frame(spark, "s string, m int, h int, f string, e boolean",
               ("OPERATED", 1, 1, None, False), ("OPERATED", 0, 1, None, True), ("ADDED", 1, 1, "ADDED_UNSCHEDULED", False),
               ("OPERATED", 1, 1, "PIPELINE_ERROR", False), ("OPERATED", 1, 1, "PIPELINE_ERROR", True), ("MISSED", 1, 1, None, True),
               ("OPERATED", None, 1, None, None))
    got = [r.x for r in df.select(flags.is_official_trip("s", "m", "h", "f", "e").alias("x")).collect()]
    assert got == [True, False, True, False, True, False, False]


def test_guards(spark):
    df = frame(spark, "t string", ("12",), ("1.5",), ("1.",), ("A1",), ("",), (None,), (" ",))
    got = df.select(guards.is_int("t"), guards.is_decimal("t"), guards.non_blank("t"), guards.blank_to_null("t"))
    assert [tuple(r) for r in got.collect()] == [
        (True, True, True, "12"), (False, True, True, "1.5"), (False, False, True, "1."), (False, False, True, "A1"),
        (False, False, False, None), (None, None, False, None), (False, False, True, None)]


def test_decode(spark):
    df = frame(spark, "c int", (0,), (3,), (9,), (None,))
    got = [r.x for r in df.select(flags.decode(flags.SCHEDULE_RELATIONSHIP, "c").alias("x")).collect()]
    assert got == ["SCHEDULED", "CANCELED", "UNKNOWN", "UNKNOWN"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 10**6)), min_size=1, max_size=30))
def test_ratios_round_half_up(spark, pairs):
    pairs = [(min(a, n), n) for a, n in pairs]
    df = frame(spark, "a bigint, n bigint", *pairs).select("a", "n", ratios.pct("a", "n", 1).alias("p"), ratios.rate("a", "n").alias("r"))
    for a, n, p, r in df.collect():
        if n == 0:
            assert p is None and r is None
        else:
            from decimal import ROUND_HALF_UP
            exact = Decimal(a) / Decimal(n)
            assert p == (exact * 100).quantize(Decimal("0.1"), ROUND_HALF_UP)
            assert r == exact.quantize(Decimal("0.0001"), ROUND_HALF_UP)


def test_miles_and_hours(spark):
    assert one(spark, flags.miles(F.lit("16093.44").cast("decimal(18,6)"))) == Decimal("10.0000")
    assert one(spark, flags.hours_of(F.lit(20))) == Decimal("0.0056")
