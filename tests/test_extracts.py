"""Served views that follow changed days, drifting tables and packed snapshots."""

from datetime import date

import pytest

from conftest import frame, rows
from test_sources import land, snapshot, trip_update
from wayside.operators import flatten
from wayside.operators.calendar import date_range
from wayside.operators.dims import describe_dates
from wayside.plans import extracts, views
from wayside.schemas import FACT_SERVICE_DAY, FACT_TRIP, conform
from wayside.sources import evolve, feeds, sinks
from wayside.sources.static import list_files


@pytest.fixture
def stored(town, tmp_path):
    spark = town.spark
    dims = {**town.dims, "date": describe_dates(date_range(spark, "2024-01-01", "2024-03-31"))}
    trip = lambda *e: conform(frame(spark, "tripkey bigint, datekey int, agencykey int, routekey int, tripstatus string", *e), FACT_TRIP)
    day = lambda *e: conform(frame(spark, "agencykey int, datekey int, peakvehiclecount int, peaktimekey int, reportedvrm int, isspecialeventday boolean, isofficial boolean, estimatedvrm int",
                                   *[(a, d, n, 480, n, False, True, 0) for a, d, n in e]), FACT_SERVICE_DAY)
    paths = {"trip": str(tmp_path / "fact_trip"), "day": str(tmp_path / "fact_service_day")}
    return spark, dims, trip, day, paths, str(tmp_path / "out")


def test_only_changed_periods_are_recomputed(stored):
    spark, dims, trip, day, paths, out = stored
    sinks.replace_partition(trip(*[(31, d, 1, 11, "MISSED") for d in (20240101, 20240102, 20240131, 20240201)]), paths["trip"], "datekey")
    sinks.replace_partition(day((1, 20240101, 5), (1, 20240131, 7), (1, 20240201, 3)), paths["day"], "datekey")
    def refresh():
        return extracts.refresh_changed(spark, paths, dims, out, ["missed_rate_by_route", "voms", "monthly_ntd"])

    def same_as_full():
        facts = {name: sinks.read_table(spark, path, extracts.FACTS[name]) for name, path in paths.items()}
        for name in ("missed_rate_by_route", "voms", "monthly_ntd"):
            view = extracts.SERVED[name]
            full = view.build(facts[view.fact], dims)
            assert rows(extracts.served(spark, out, name), *full.columns) == rows(full), name
        return True

    everything = {"missed_rate_by_route": [20240101, 20240102, 20240131, 20240201], "voms": [202401, 202402], "monthly_ntd": [202401, 202402]}
    assert refresh() == everything and same_as_full()
    assert refresh() == {"missed_rate_by_route": [], "voms": [], "monthly_ntd": []}
    sinks.replace_partition(trip((31, 20240102, 1, 11, "OPERATED")), paths["trip"], "datekey")
    sinks.replace_partition(day((1, 20240131, 9)), paths["day"], "datekey")
    before = list_files(spark, f"{out}/missed_rate_by_route/period=20240101/*"), list_files(spark, f"{out}/voms/period=202402/*")
    assert refresh() == {"missed_rate_by_route": [20240102], "voms": [202401], "monthly_ntd": [202401]} and same_as_full()
    assert (list_files(spark, f"{out}/missed_rate_by_route/period=20240101/*"), list_files(spark, f"{out}/voms/period=202402/*")) == before
    sinks.replace_days(trip().limit(0), paths["trip"], "datekey", trip((31, 20240201, 1, 11, "MISSED")))  # a day that goes
    assert refresh()["missed_rate_by_route"] == [20240201] and same_as_full()


def test_a_refresh_opens_the_changed_days_only(stored):
    spark, _, trip, _, paths, _ = stored
    sinks.replace_partition(trip(*[(31, d, 1, 11, "MISSED") for d in (20240101, 20240102, 20240201)]), paths["trip"], "datekey")
    fact = sinks.read_table(spark, paths["trip"], FACT_TRIP)
    for periods, months, kept in (([20240102], False, {20240102}), ([202401], True, {20240101, 20240102})):
        some = extracts.within(fact, periods, months)
        assert {r.datekey for r in some.collect()} == kept
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "datekey" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_every_served_view_names_its_period(town):
    facts = {name: conform(town.spark.range(0), ddl) for name, ddl in extracts.FACTS.items()}
    for name, view in extracts.SERVED.items():
        built = view.build(facts[view.fact], town.dims)
        assert view.months or view.period in built.columns
        if view.months:
            built.selectExpr(view.period)
    assert set(extracts.SERVED) <= set(views.create_views(facts, town.dims, "2024-01-07"))


def test_drifting_days(spark, tmp_path):
    path, ddl = str(tmp_path / "stops"), "stop_id string, stop_lat double"
    d = lambda n: date(2024, 1, n)
    assert evolve.write_evolved(frame(spark, "stop_id string, zone int", ("a", 1)), path, d(1), ddl) == ["zone"]
    assert evolve.write_evolved(frame(spark, "stop_lat double, stop_id string", (1.5, "b")), path, d(2), ddl) == []
    assert evolve.write_evolved(frame(spark, "stop_id string, zone string, `odd name` string", ("c", "x", "y")), path, d(3), ddl) == ["odd name"]
    assert evolve.write_evolved(frame(spark, "stop_id string, zone int", ("a2", 7)), path, d(1), ddl) == []
    got = evolve.read_evolved(spark, path, ddl)
    assert got.columns == ["stop_id", "stop_lat", "zone", "odd name", "load_date"]
    assert rows(got) == [("a2", None, "7", None, d(1)), ("b", 1.5, None, None, d(2)), ("c", None, "x", "y", d(3))]
    assert evolve.read_evolved(spark, path, f"{ddl}, zone string").columns == ["stop_id", "stop_lat", "zone", "odd name", "load_date"]
    assert evolve.read_evolved(spark, str(tmp_path / "none"), ddl).count() == 0


def test_packed_snapshots_read_alike(spark, tmp_path):
    root, out = tmp_path / "feeds", str(tmp_path / "packed")
    for minute in range(12):
        body = snapshot(1_704_182_400 + 60 * minute, trip_update(f"t{minute}", {"stop_id": "s", "stop_sequence": 1, "arrival": {"time": 1_704_182_400, "delay": minute}}))
        land(root, "north" if minute % 3 else "south", "trip-updates", f"2024/01/02/08{minute:02d}00", body)
    made = feeds.compact_day(spark, str(root), out, "2024-01-02", target_bytes=600)
    assert set(made) == {"north/trip-updates/2024/01/02", "south/trip-updates/2024/01/02"} and 1 < made["north/trip-updates/2024/01/02"] < 8
    def flat(where):
        return rows(flatten.flatten_trip_updates(flatten.valid_snapshots(feeds.read_feed(spark, where, day="2024-01-02"))))

    assert flat(out) == flat(str(root)) and len(flat(out)) == 12
    assert feeds.compact_day(spark, str(root), out, "2024-01-02") == dict.fromkeys(made, 1) and flat(out) == flat(str(root))
