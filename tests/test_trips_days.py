from datetime import datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import frame, rows
from wayside.operators import days, trips
from wayside.schemas import FACT_TRIP, conform


def at(day, h, m, s=0):
    return datetime(2024, 1, day, h, m, s)


@pytest.fixture(scope="module")
def skeleton(town):
    return trips.trip_skeleton(town.stg, town.dims, town.dates).cache()


def test_scheduled_miles_and_hours(town):
    assert rows(trips.shape_miles(town.stg["shapes"])) == [("h1", Decimal("10.0000")), ("h2", None)]
    scoped = trips.shape_miles(town.stg["shapes"], town.stg["trips"].filter("trip_id = 't3'"))
    assert rows(scoped, "shape_id") == [("h2",)]
    hours = dict(rows(trips.trip_hours(town.stg["stop_times"])))
    assert hours["t1"] == Decimal("0.3417") and hours["t2"] == Decimal("1.4167") and hours["t3"] == Decimal("1.0000")
    assert "t9" in hours and "t9" not in dict(rows(trips.trip_hours(town.stg["stop_times"], town.stg["trips"])))


def test_negative_hours_are_null(spark):
    times = frame(spark, "trip_id string, arrival_time string, departure_time string, stop_sequence string", ("a", "10:00:00", "09:00:00", "1"))
    assert rows(trips.trip_hours(times)) == [("a", None)]


def test_skeleton_statuses(skeleton):
    got = rows(skeleton, "tripkey", "datekey", "tripstatus", "tripstatussource", "isspecialevent")
    week = (31, 32, 35)
    expected = [(t, 20240100 + d, "MISSED", "INFERRED", False) for t in week for d in (1, 2, 4, 5, 7)]
    expected += [(t, 20240103, "CANCELLED", "CALENDAR", False) for t in week]
    expected += [(33, 20240106, "MISSED", "INFERRED", True), (34, 20240106, "MISSED", "INFERRED", False)]
    assert got == sorted(expected)
    one = skeleton.filter("tripkey = 31 and datekey = 20240101").first()
    assert (one.scheduledvrm, one.reportedvrm, one.scheduledvrh) == (Decimal("10.0000"), Decimal("10.0000"), Decimal("0.3417"))
    lost = skeleton.filter("tripkey = 35").first()
    assert (lost.routekey, lost.agencykey, lost.scheduledvrm, lost.versionkey) == (0, 0, Decimal("0.0000"), 7)


def test_skeleton_is_idempotent_and_can_be_forced(town, skeleton):
    assert trips.trip_skeleton(town.stg, town.dims, town.dates, skeleton).count() == 0
    assert trips.trip_skeleton(town.stg, town.dims, town.dates, skeleton, True).count() == skeleton.count()


def merged(town, skeleton, *pings, **options):
    return trips.merge_pings(skeleton, town.pings(*pings), town.dims, **options)


def test_ping_merge(town, skeleton):
    fact = merged(
        town, skeleton,
        ("t1", at(1, 8, 0)), ("t1", at(1, 8, 30)), ("t1", at(1, 8, 10)),
        ("t2", at(1, 9, 0)),
        ("t1", at(3, 8, 0)), ("t1", at(3, 8, 30)),
        ("t1", at(2, 8, 0)), ("t1", at(2, 8, 0, 20)), ("t1", at(2, 8, 0, 10)),
        ("", at(1, 8, 0)), (None, at(1, 8, 0)), ("t1", None),
    )
    assert fact.count() == skeleton.count()
    got = rows(fact.filter("tripkey in (31, 32) and datekey <= 20240103"), "tripkey", "datekey", "tripstatus", "actualpingcount",
               "expectedpingcount", "rtcoveragerate", "reportedvrh", "isestimated")
    assert got == [
        (31, 20240101, "OPERATED", 3, 60, Decimal("0.0500"), Decimal("0.5000"), True),
        (31, 20240102, "OPERATED", 3, 0, Decimal("1.0000"), Decimal("0.0056"), True),
        (31, 20240103, "CANCELLED", None, None, None, Decimal("0.3417"), True),
        (32, 20240101, "OPERATED", 1, 0, None, Decimal("1.4167"), True),
        (32, 20240102, "MISSED", None, None, None, Decimal("1.4167"), True),
        (32, 20240103, "CANCELLED", None, None, None, Decimal("1.4167"), True),
    ]
    again = merged(town, fact, ("t1", at(1, 7, 0)), ("t1", at(1, 9, 0)))
    assert rows(again) == rows(fact)
    forced = merged(town, fact, ("t1", at(1, 7, 0)), ("t1", at(1, 9, 0)), force=True)
    assert forced.filter("tripkey = 31 and datekey = 20240101").first().reportedvrh == Decimal("2.0000")


def test_service_day_cutoff(town, skeleton):
    late = [("t2", at(1, 23, 50)), ("t2", at(2, 1, 10))]
    default = merged(town, skeleton, *late).filter("tripkey = 32 and datekey = 20240101").first()
    shifted = merged(town, skeleton, *late, cutoff_hour=4).filter("tripkey = 32 and datekey = 20240101").first()
    assert default.actualpingcount == 1 and shifted.actualpingcount == 2


def test_added_trips(town):
    pings = town.pings(("ghost", at(1, 8, 0), "1"), ("ghost", at(1, 9, 0), "1"), ("ghost", at(1, 9, 0), "zz"), ("t1", at(1, 8, 0), "1"))
    added = trips.added_trips(pings, town.stg["trips"], town.dims)
    got = rows(added, "tripkey", "agencykey", "tripstatus", "reportedvrm", "reportedvrh", "dataqualityflag", "versionkey")
    assert got == [
        (0, 0, "ADDED", Decimal("0.0000"), Decimal("0.0000"), "ADDED_UNSCHEDULED", 7),
        (0, 1, "ADDED", Decimal("1.0000"), Decimal("1.0000"), "ADDED_UNSCHEDULED", 7),
    ]
    assert rows(trips.replace_added(added, added)) == rows(added)
    names = frame(town.spark, "agency_key string, agencyid string", ("zz", "40"))
    named = trips.added_trips(pings, town.stg["trips"], town.dims, agency_ids=names)
    assert rows(named, "agencykey") == [(1,), (2,)]
    empty_miles = trips.added_trips(pings, town.stg["trips"], town.dims, added_vrm=None)
    assert {r.reportedvrm for r in empty_miles.collect()} == {None}


def test_backfill_only_touches_operated(town, skeleton):
    fact = merged(town, skeleton, ("t1", at(1, 8, 0)))
    pings = town.pings(("t1", at(1, 7, 0), "1"), ("t1", at(1, 7, 30), "1"), ("t1", at(1, 6, 0), "40"), ("t2", at(1, 7, 0), "1"))
    filled = trips.backfill_actual_times(fact, pings, town.dims)
    one = filled.filter("tripkey = 31 and datekey = 20240101").first()
    assert (one.actualstarttime, one.actualendtime, one.isestimated) == (at(1, 7, 0), at(1, 7, 30), False)
    assert filled.filter("tripkey = 32 and actualstarttime is not null").count() == 0


def trip_rows(spark, *entries):
    """Operated trips of agency 1 from (start, end) or full (status, start, end, special, pings, estimated)."""
    ddl = ("tripkey bigint, datekey int, agencykey int, tripstatus string, actualstarttime timestamp_ntz, actualendtime timestamp_ntz,"
           " isspecialevent boolean, actualpingcount int, isestimated boolean, reportedvrm int, reportedvrh int")
    full = [("OPERATED", *e, False, 1, False) if len(e) == 2 else e for e in entries]
    return conform(frame(spark, ddl, *[(i + 1, 20240101, 1, s, a, b, x, p, e, 10, 2) for i, (s, a, b, x, p, e) in enumerate(full)]), FACT_TRIP)


def test_peak_tie_takes_latest_minute(spark):
    fact = trip_rows(spark, (at(1, 7, 50), at(1, 8, 0)), (at(1, 8, 0), at(1, 8, 5)), (at(1, 17, 0), at(1, 17, 0)), (at(1, 16, 0), at(1, 17, 0)))
    assert rows(days.peak_vehicles(fact)) == [(1, 20240101, 2, 1020)]


def brute_force(spans, rule):
    """Active trips per minute by checking every minute of every trip."""
    counts = {}
    for a, b in spans:
        start, end = a.hour * 60 + a.minute, b.hour * 60 + b.minute
        for m in range(1440):
            if rule == "wrap":
                active = start <= m <= end if start <= end else m >= start or m <= end
            else:
                active = (m >= start or m <= end) if a > b else start <= m <= end
            if active:
                counts[m] = counts.get(m, 0) + 1
    return counts


moment = st.builds(lambda d, m: at(1 + d, m // 60, m % 60, 30), st.integers(0, 1), st.integers(0, 1439))


@pytest.mark.parametrize("rule", ["wrap", "clock"])
@settings(max_examples=6, deadline=None)
@given(spans=st.lists(st.tuples(moment, moment), min_size=1, max_size=12))
def test_active_minutes_match_brute_force(spark, rule, spans):
    fact = trip_rows(spark, *spans)
    expected = brute_force(spans, rule)
    got = {r.timekey: r.active_trips for r in days.active_per_minute(fact, rule).collect()}
    assert got == expected
    peak = days.peak_vehicles(fact, rule).collect()
    if expected:
        top = max(expected.values())
        assert (peak[0].peakvehiclecount, peak[0].peaktimekey) == (top, max(m for m, n in expected.items() if n == top))
    else:
        assert peak == []


def test_service_day(spark):
    fact = trip_rows(
        spark,
        ("OPERATED", at(1, 8, 0), at(1, 9, 0), False, 5, False), ("OPERATED", at(1, 8, 30), at(1, 9, 30), False, None, True),
        ("ADDED", at(1, 8, 0), at(1, 9, 0), False, 5, True), ("MISSED", None, None, False, None, True),
        ("CANCELLED", None, None, False, None, True), ("MISSED", None, None, False, None, False),
    )
    day = days.service_day(fact).first()
    assert (day.scheduledtrips, day.operatedtrips, day.missedtrips, day.cancelledtrips) == (6, 3, 2, 1)
    assert day.scheduledtrips == day.operatedtrips + day.missedtrips + day.cancelledtrips
    assert day.missedtriprate == Decimal("0.4000") and day.reportedvrm == 30 and day.estimatedvrm == 20
    assert (day.peakvehiclecount, day.peaktimekey) == (2, 540)
    assert (day.feedgapflag, day.dataqualityalertflag, day.isofficial) == (True, True, False)


def test_all_cancelled_day(spark):
    day = days.service_day(trip_rows(spark, ("CANCELLED", None, None, False, None, True))).first()
    assert day.missedtriprate is None and (day.peakvehiclecount, day.peaktimekey) == (0, 0)
    assert (day.feedgapflag, day.dataqualityalertflag, day.isofficial) == (False, False, False)


def test_alert_shares_are_strict(spark):
    exact = [("OPERATED", None, None, False, 1 if i >= 4 else None, i < 3) for i in range(20)]
    day = days.service_day(trip_rows(spark, *exact)).first()
    assert (day.feedgapflag, day.dataqualityalertflag, day.isofficial) == (False, False, True)


def test_special_trips_mark_the_day_and_stay_out_of_the_peak(spark):
    day = days.service_day(trip_rows(spark, ("OPERATED", at(1, 8, 0), at(1, 9, 0), True, 1, False))).first()
    assert day.isspecialeventday and day.peakvehiclecount == 0 and not day.isofficial


def test_skeleton_combines_before_rows_move(town):
    """Shapes and stop times go into their aggregation as they are; no join moves them before."""
    plan = trips.trip_skeleton(town.stg, town.dims, town.dates)._jdf.queryExecution().analyzed().toString()
    semi = [line for line in plan.splitlines() if "Join LeftSemi" in line]
    assert semi and not [line for line in semi if "shape_id" in line or "trip_id" in line]
