from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wayside.operators import stops
from wayside.operators.calendar import date_range

KEYS = ["tripkey", "stopkey", "stopsequence", "datekey"]


@pytest.fixture(scope="module")
def skeleton(town):
    return stops.stop_skeleton(town.stg, town.dims, town.dates).cache()


def test_skeleton_rows(skeleton):
    one_day = skeleton.filter("datekey = 20240101")
    got = rows(one_day, *KEYS, "routekey", "agencykey", "timekey", "scheduledarrivalseconds", "isoriginstop", "isterminalstop", "versionkey")
    assert got == [
        (31, 21, 1, 20240101, 11, 1, 480, 28_800, True, False, 7),
        (31, 22, 2, 20240101, 11, 1, 490, 29_400, False, False, 7),
        (31, 23, 3, 20240101, 11, 1, 500, 30_000, False, True, 7),
        (32, 21, 4, 20240101, 11, 1, 75, 90_900, False, True, 7),
        (32, 22, 2, 20240101, 11, 1, 30, 88_200, False, False, 7),
        (32, 23, 1, 20240101, 11, 1, 1430, 85_800, True, False, 7),
    ]
    first = one_day.first()
    assert (first.arrivalsource, first.isestimated, first.isofficial, first.ismissed) == ("FALLBACK_SCHEDULED", True, False, False)
    assert first.isontime is None and first.isbunching is None and first.stopperformancekey is None


def test_cancelled_day_has_no_stop_rows(skeleton):
    assert skeleton.filter("datekey = 20240103").count() == 0
    assert rows(skeleton.filter("datekey = 20240106"), "tripkey", "stopsequence") == [(33, 1), (33, 2), (34, 5), (34, 9)]


def test_skeleton_twice_adds_nothing(town, skeleton):
    assert stops.stop_skeleton(town.stg, town.dims, town.dates, skeleton).count() == 0
    part = skeleton.filter("stopsequence > 1")
    again = stops.stop_skeleton(town.stg, town.dims, town.dates, part)
    assert rows(again, *KEYS) == rows(skeleton.filter("stopsequence = 1"), *KEYS)


def test_range_equals_union_of_days(town, skeleton):
    parts = [stops.stop_skeleton(town.stg, town.dims, date_range(town.spark, d, d)) for d in
             (f"2024-01-0{i}" for i in range(1, 8))]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    assert rows(union) == rows(skeleton)


def at(h, m, s=0):
    return datetime(2024, 1, 1, h, m, s)


def test_merge(town, skeleton):
    day = date(2024, 1, 1)
    updates = town.updates(
        ("t1", "s1", 1, day, at(7, 58, 59), at(1, 0)),      # 61 s early
        ("t1", "s2", 2, day, at(8, 9), at(1, 0)),           # overtaken by a later feed
        ("t1", "s2", 2, day, at(8, 15), at(2, 0)),          # 300 s late: on time
        ("t1", "s3", 3, day, at(8, 25, 1), at(1, 0)),       # 301 s late
        ("t2", "s3", 1, day, None, at(1, 0)),               # no arrival
        ("t2", "s1", 4, day, datetime(2024, 1, 2, 1, 14), at(1, 0)),  # overnight, 60 s early: on time
        ("t7", "s1", 1, day, at(8, 0), at(1, 0)),           # unknown trip
    )
    merged = stops.stop_official(stops.merge_stop_updates(skeleton, updates, town.dims)).filter("datekey = 20240101")
    got = rows(merged, "tripkey", "stopsequence", "arrivaldevseconds", "isearly", "isontime", "islate", "arrivalsource", "isestimated", "isofficial")
    reported, fallback = "GTFS_RT_REPORTED", "FALLBACK_SCHEDULED"
    assert got == [
        (31, 1, -61, True, False, False, reported, False, False),
        (31, 2, 300, False, True, False, reported, False, True),
        (31, 3, 301, False, False, True, reported, False, False),
        (32, 1, None, None, None, None, fallback, True, False),
        (32, 2, None, None, None, None, fallback, True, False),
        (32, 4, -60, False, True, False, reported, False, False),
    ]
    # merging again changes nothing, and row counts never grow
    again = stops.stop_official(stops.merge_stop_updates(merged, updates, town.dims))
    assert rows(again) == rows(merged)
    later = town.updates(("t1", "s2", 2, day, at(8, 10), at(5, 0)))
    untouched = stops.merge_stop_updates(merged, later, town.dims)
    assert rows(untouched) == rows(merged)
    forced = stops.merge_stop_updates(merged, later, town.dims, force=True).filter("tripkey = 31 and stopsequence = 2")
    assert forced.first().arrivaldevseconds == 0


def test_flags_partition_evaluated_rows(town, skeleton):
    updates = town.updates(*[("t1", f"s{i}", i, date(2024, 1, d), datetime(2024, 1, d, 8, 10 * i - 12 + 3 * d), at(1, 0))
                             for i in (1, 2, 3) for d in (2, 4, 5)])
    merged = stops.merge_stop_updates(skeleton, updates, town.dims)
    evaluated = merged.filter(F.col("isontime").isNotNull())
    assert evaluated.count() == 9
    bad = evaluated.filter(F.col("isontime").cast("int") + F.col("isearly").cast("int") + F.col("islate").cast("int") != 1)
    assert bad.count() == 0


def test_mark_ends_equals_window(town):
    visits = stops.stop_visits(town.stg["stop_times"])
    from pyspark.sql import Window
    over = Window.partitionBy("trip_id")
    expected = visits.select("*", (F.col("stop_sequence") == F.min("stop_sequence").over(over)).alias("is_origin"),
                             (F.col("stop_sequence") == F.max("stop_sequence").over(over)).alias("is_terminal"))
    assert rows(stops.mark_ends(visits)) == rows(expected)


def test_merge_keeps_days_of_a_visit_together(town, skeleton):
    """Reports of many days and months meet their own day only, and rows move by visit and month."""
    updates = town.updates(*[("t1", "s1", 1, date(2024, m, d), datetime(2024, m, d, 8, d), at(1, 0)) for m in (1, 2) for d in (1, 2, 4, 5)])
    merged = stops.merge_stop_updates(skeleton, updates, town.dims)
    assert merged.count() == skeleton.count()
    got = rows(merged.filter("arrivalsource = 'GTFS_RT_REPORTED'"), "tripkey", "stopsequence", "datekey", "arrivaldevseconds")
    assert got == [(31, 1, 20240100 + d, 60 * d) for d in (1, 2, 4, 5)]
    thresholds = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in thresholds:
        town.spark.conf.set(name, "-1")
    try:
        plan = stops.merge_stop_updates(skeleton, updates, town.dims)._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in thresholds:
            town.spark.conf.unset(name)
    moved = [line for line in plan.splitlines() if "hashpartitioning(tripkey" in line and "stopkey" in line]
    assert moved and all("_month" in line and "datekey" not in line for line in moved)
