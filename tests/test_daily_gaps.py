from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import frame, rows
from wayside.operators import gaps
from wayside.operators.calendar import date_range
from wayside.plans import daily, reports, views
from wayside.schemas import FACT_SERVICE_DAY, FACT_STOP, FACT_TRIP, conform


def at(day, h, m):
    return datetime(2024, 1, day, h, m)


@pytest.fixture(scope="module")
def live(town):
    updates = town.updates(*[("t1", f"s{i}", i, date(2024, 1, d), at(d, 8, 10 * i - 8), at(d, 9, 0)) for i in (1, 2, 3) for d in (1, 2, 4)])
    pings = town.pings(*[("t1", at(d, 8, m)) for d in (1, 2, 3, 4) for m in (0, 15, 29)], ("t2", at(1, 23, 50)), ("ghost", at(2, 7, 0)), ("ghost", at(2, 8, 0)))
    return updates, pings


@pytest.fixture(scope="module")
def loaded(town, live, tmp_path_factory):
    house = daily.Warehouse(town.spark, str(tmp_path_factory.mktemp("house")))
    house.run(town.stg, town.dims, *live, town.dates)
    return house


def test_one_job_equals_day_by_day(town, live, loaded, tmp_path):
    single = daily.Warehouse(town.spark, str(tmp_path))
    single.run_range(town.stg, town.dims, *live, date(2024, 1, 1), date(2024, 1, 7), days_per_job=3)
    assert rows(single.stop()) == rows(loaded.stop())
    assert rows(single.trip()) == rows(loaded.trip())
    assert rows(single.day()) == rows(loaded.day())


def test_rerun_changes_nothing(town, live, loaded):
    before = rows(loaded.stop()), rows(loaded.trip()), rows(loaded.day())
    loaded.run(town.stg, town.dims, *live, date_range(town.spark, "2024-01-01", "2024-01-02"))
    assert (rows(loaded.stop()), rows(loaded.trip()), rows(loaded.day())) == before


def test_day_fact_follows_trip_fact(loaded):
    got = rows(loaded.day(), "datekey", "agencykey", "scheduledtrips", "operatedtrips", "missedtrips", "cancelledtrips", "unmatchedtripcount")
    assert got[:3] == [(20240101, 0, 1, 0, 1, 0, 0), (20240101, 1, 2, 2, 0, 0, 0), (20240102, 0, 1, 0, 1, 0, 0)]
    assert (20240102, 1, 3, 2, 1, 0, 1) in got and (20240103, 1, 2, 0, 0, 2, 0) in got


def test_new_days_are_not_compared_with_stored_ones(town, live, loaded):
    """Days that hold nothing yet come from the skeleton alone; days that do are still compared."""
    for days, compared in ((("2024-01-08", "2024-01-09"), False), (("2024-01-02", "2024-01-03"), True)):
        dates = date_range(town.spark, *days)
        stop = daily.build_stop_fact(town.stg, town.dims, live[0], dates, loaded.stop(), "skeleton")
        trip = daily.build_trip_fact(town.stg, town.dims, live[1], dates, loaded.trip(), "skeleton")
        for fact in (stop, trip):
            plan = fact._jdf.queryExecution().optimizedPlan().toString()
            assert ("LeftAnti" in plan) == compared


def test_phases(town, live, tmp_path):
    house = daily.Warehouse(town.spark, str(tmp_path))
    day = date_range(town.spark, "2024-01-01", "2024-01-01")
    house.run(town.stg, town.dims, *live, day, phase="skeleton")
    assert {r.arrivalsource for r in house.stop().collect()} == {"FALLBACK_SCHEDULED"} and house.day().count() == 0
    house.run(town.stg, town.dims, *live, day, phase="merge")
    assert house.stop().filter("arrivalsource = 'GTFS_RT_REPORTED'").count() == 3
    house.backfill_times(town.dims, live[1], day)
    assert house.trip().filter("tripstatus = 'OPERATED' and not isestimated").count() == 2
    house.load_trips(town.stg, town.dims, live[1], day, phase="skeleton", force_skeleton=True)
    assert house.trip().filter("tripstatus = 'OPERATED'").count() == 0
    with pytest.raises(ValueError, match="phase"):
        house.run(town.stg, town.dims, *live, day, phase="all")
    with pytest.raises(ValueError, match="after end"):
        house.run_range(town.stg, town.dims, *live, date(2024, 1, 2), date(2024, 1, 1))


def test_days_left_without_trips_are_emptied(town, live, tmp_path):
    house = daily.Warehouse(town.spark, str(tmp_path))
    days = date_range(town.spark, "2024-01-01", "2024-01-02")
    house.run(town.stg, town.dims, *live, days)
    monday = date_range(town.spark, "2024-01-01", "2024-01-01")
    no_service = {**town.stg, "calendar": town.stg["calendar"].limit(0), "calendar_dates": town.stg["calendar_dates"].limit(0)}
    house.load_trips(no_service, town.dims, live[1], monday, phase="skeleton", force_skeleton=True)
    house.load_days(monday)
    assert {r.datekey for r in house.trip().collect()} == {r.datekey for r in house.day().collect()} == {20240102}


def test_options_reach_the_operators(town, live, tmp_path):
    names = town.spark.createDataFrame([("north-feed", "1")], "agency_key string, agencyid string")
    pings = town.pings(("ghost", at(2, 7, 0), "north-feed"), ("ghost", at(2, 8, 0), "north-feed"), ("t2", at(2, 1, 30)))
    options = daily.Options(cutoff_hour=3, agency_ids=names, added_vrm=None, estimated_scope=False)
    house = daily.Warehouse(town.spark, str(tmp_path), options)
    house.load_trips(town.stg, town.dims, pings, date_range(town.spark, "2024-01-01", "2024-01-02"))
    added = house.trip().filter("tripkey = 0").collect()
    assert [(r.datekey, r.agencykey, r.reportedvrm) for r in added] == [(20240102, 1, None)]
    ran = house.trip().filter("tripstatus = 'OPERATED'").collect()
    assert [(r.datekey, r.tripkey, r.isestimated) for r in ran] == [(20240101, 32, False)]


def land_timetable(town, root, **changed):
    for name, df in {**town.stg, **changed}.items():
        df.write.option("header", True).csv(f"{root}/2024/01/01/{name}.txt")


def test_timetable_day_is_gated_and_skips_known_feeds(town, tmp_path):
    root, house = str(tmp_path / "static"), daily.Warehouse(town.spark, str(tmp_path / "house"))
    land_timetable(town, root, stop_times=town.stg["stop_times"].filter("stop_sequence <> 'A1'"))
    feed = frame(town.spark, "feedhash string, ingestedat timestamp_ntz", ("aa", at(1, 3, 0)))
    assert house.load_timetable_day(root, date(2024, 1, 1), feed)
    assert rows(house.staging()["trips"], "trip_id") == rows(town.stg["trips"], "trip_id")
    assert rows(house.versions(), "versionkey", "feedhash", "iscurrent") == [(1, "aa", True)]
    assert not house.load_timetable_day(root, date(2024, 1, 1), feed)
    bad = str(tmp_path / "bad")
    land_timetable(town, bad, trips=town.stg["trips"].unionByName(town.stg["trips"]))
    with pytest.raises(ValueError, match="trips"):
        house.load_timetable_day(bad, date(2024, 1, 1))
    assert house.staging()["trips"].count() == town.stg["trips"].count()


def test_verdicts_of_loaded_days_are_read_from_their_reports(town, tmp_path):
    root, house = str(tmp_path / "static"), daily.Warehouse(town.spark, str(tmp_path / "house"))
    assert house.validations().count() == 0
    land_timetable(town, root, stop_times=town.stg["stop_times"].filter("stop_sequence <> 'A1'"))
    house.load_timetable_day(root, date(2024, 1, 1))
    summary = town.spark.read.json(f"{house.root}/validation/2024-01-01/summary").first()
    assert rows(house.validations()) == [(date(2024, 1, 1), summary.overall_passed, summary.passed, summary.total_tables)]


def test_coexisting_versions_do_not_fan_out(town, live, loaded):
    both = {**town.dims, "route": town.dims["route"].unionByName(town.dims["route"].selectExpr("routekey - 10 as routekey", "agencykey", "routeid", "routeshortname", "routelongname", "routetype", "0 as versionkey"))}
    fact = daily.build_trip_fact(town.stg, both, live[1], town.dates)
    assert rows(fact, "tripkey", "datekey", "routekey") == rows(loaded.trip(), "tripkey", "datekey", "routekey")


def test_only_wanted_partitions_are_read(town, loaded):
    plan = daily.on_dates(loaded.stop(), date_range(town.spark, "2024-01-02", "2024-01-02"))
    assert {r.datekey for r in plan.collect()} == {20240102}
    text = plan._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in text.splitlines() if "PartitionFilters" in line][0]
    assert "datekey" in filters.split("PartitionFilters")[1].split("PushedFilters")[0] and "Subquery" in filters.split("PartitionFilters")[1]


def test_failed_parts_are_reported_together(town, live, tmp_path):
    house = daily.Warehouse(town.spark, str(tmp_path))
    no_trips = {**town.dims, "trip": town.dims["trip"].limit(0)}
    with pytest.raises(RuntimeError, match="2 part"):
        house.run_range(town.stg, no_trips, *live, date(2024, 1, 1), date(2024, 1, 2), days_per_job=1)


def stored(spark, ddl, contract, *entries):
    return conform(frame(spark, ddl, *entries), contract)


def test_work_list(town):
    spark = town.spark
    updates = town.updates(*[("t", "s", 1, date(2024, 1, d), None, None) for d in (1, 2, 3)], ("t", "s", 1, date(2023, 1, 1), None, None))
    pings = town.pings(*[("t", at(d, 8, 0)) for d in (1, 2, 3, 5)])
    stop = stored(spark, "datekey int, arrivalsource string", FACT_STOP, (20240101, "GTFS_RT_REPORTED"), (20240102, "FALLBACK_SCHEDULED"), (20240102, "GTFS_RT_REPORTED"))
    trip = stored(spark, "datekey int, agencykey int, tripstatus string", FACT_TRIP, (20240101, 1, "OPERATED"), (20240102, 1, "OPERATED"), (20240102, 1, "MISSED"),
                  (20240103, 1, "OPERATED"), (20240103, 2, "OPERATED"), (20240105, 1, "CANCELLED"))
    day = stored(spark, "datekey int, agencykey int", FACT_SERVICE_DAY, (20240101, 1), (20240103, 1))
    found = gaps.gap_dates(updates, pings, stop, trip, day, "2024-01-10")
    d = lambda n: date(2024, 1, n)
    assert rows(found) == sorted([
        (gaps.STOP_JOB, d(2), "merge"), (gaps.STOP_JOB, d(3), "missing"), (gaps.TRIP_JOB, d(2), "merge"),
        (gaps.DAY_JOB, d(2), "missing"), (gaps.DAY_JOB, d(3), "missing")])
    work = {r.job: (r.skip, r.phase, r.gap_dates) for r in gaps.work_list(found).collect()}
    assert work == {gaps.STOP_JOB: (False, "both", [d(2), d(3)]), gaps.TRIP_JOB: (False, "merge", [d(2)]), gaps.DAY_JOB: (False, "load", [d(2), d(3)])}
    nothing = {r.job: (r.skip, r.phase) for r in gaps.work_list(found.limit(0)).collect()}
    assert set(nothing.values()) == {(True, "none")} and len(nothing) == 3
    assert rows(gaps.job_dates(gaps.work_list(found), gaps.STOP_JOB)) == [(d(2),), (d(3),)]


def test_run_work_list_fills_the_gaps(town, live, tmp_path):
    house = daily.Warehouse(town.spark, str(tmp_path))
    house.run_work_list(town.stg, town.dims, *live, as_of="2024-01-05")
    assert sorted({r.datekey for r in house.stop().collect()}) == [20240101, 20240102, 20240104]
    assert sorted({r.datekey for r in house.day().collect()}) == [20240101, 20240102, 20240103, 20240104]


def test_views(town, loaded):
    facts = {"stop": loaded.stop(), "trip": loaded.trip(), "day": loaded.day()}
    made = views.create_views(facts, town.dims, "2024-01-07")
    months = made["otp_by_route_month"].first()
    assert (months.routeshortname, months.total_obs, months.ontime, months.early, months.late, float(months.otp_pct)) == ("One", 3, 3, 0, 0, 100.0)
    assert made["monthly_ntd"].count() == 0  # every operated day is estimated, so none is official
    assert made["quality_alerts"].count() == 3
    assert rows(made["quality_daily"], "fulldate", "total", "official")[0] == (date(2024, 1, 1), 6, 1)
    summary = views.daily_otp_summary(facts["stop"], town.dims, "2024-01-05", "2024-01-02")
    assert rows(summary, "fulldate", "total_obs", "unique_trips") == [(date(2024, 1, d), 6, 2) for d in (2, 4, 5)]
    assert made["voms"].filter("isnotnull(peak_period)").count() == 3
    assert set(views.register_views(facts, town.dims, "2024-01-07")) == set(made)
    assert town.spark.sql("select max(peakvehiclecount) from voms").first()[0] == 1
    report = reports.voms_report(made["voms"])
    assert report["kpi_monthly"].first().previous is None and report["detail"].count() >= 1
    alerts = reports.alert_report(made["quality_alerts"], ["North"])
    assert float(alerts["coverage"].first().rt_coverage_rate) == pytest.approx(5 / 7)
    assert alerts["bars"].count() == alerts["table"].count() == 3
    assert reports.otp_trend_report(summary)["weekdays"].count() == 3


def test_late_routes(town):
    spark = town.spark
    entries = []
    for d in range(1, 8):
        entries += [(11, 1, 20240100 + d, True, False)] * 3 + [(11, 1, 20240100 + d, True, True)]  # 25 %
        entries += [(12, 2, 20240100 + d, True, d > 4)]  # below on four days only
        entries += [(12, 2, 20240100 + d, False, False)] * 5
    stops = stored(spark, "routekey int, agencykey int, datekey int, isofficial boolean, isontime boolean", FACT_STOP, *entries)
    late = views.routes_consistently_late(stops, town.dims, "2024-01-07").collect()
    assert [(r.routekey, r.days_below_70pct, float(r.avg_otp_pct), float(r.worst_day_otp_pct)) for r in late] == [(11, 7, 25.0, 25.0)]
    assert views.routes_consistently_late(stops, town.dims, "2024-02-02").collect()[0].days_evaluated == 5
    assert views.routes_consistently_late(stops, town.dims, "2024-02-05").count() == 0


def test_top_routes_limit(spark):
    months = frame(spark, "routeshortname string, total_obs bigint, otp_pct decimal(6,1)", *[(f"r{i:02d}", i, Decimal(50 + i % 3)) for i in range(15)])
    assert {r.routeshortname for r in reports.top_routes(months).collect()} == {f"r{i:02d}" for i in range(5, 15)}
    best = reports.top_route_otp(months, 2).collect()
    assert [(r.routeshortname, r.otp_pct) for r in best] == [("r14", Decimal("52.0")), ("r13", Decimal("51.0"))]
