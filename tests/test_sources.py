import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import frame, rows
from wayside.operators import flatten, quality
from wayside.schemas import FACT_SERVICE_DAY, STAGING_COLUMNS
from wayside.sources import feeds, sinks, static


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "static" / "2024" / "01" / "05"
    folder.mkdir(parents=True)
    (folder / "stops.txt").write_text('﻿stop_id , STOP_NAME,stop_lat,extra\ns1,"Main, North",47.5,x\ns2,  ,,\n', encoding="utf-8")
    (folder / "feed_info.txt").write_text('feed_publisher_name,feed_version,feed_start_date,feed_end_date\n"Lines, Inc.", v1 ,20240101,20241231\n')
    return str(tmp_path / "static")


def test_read_static(spark, root):
    df = static.read_static(spark, root, "stops", "2024-01-05")
    assert df.columns == [*STAGING_COLUMNS["stops"], "extra"]
    assert rows(df, "stop_id", "stop_name", "stop_lat", "zone_id", "extra") == [("s1", "Main, North", "47.5", None, "x"), ("s2", None, None, None, None)]
    assert static.extra_columns(df, STAGING_COLUMNS["stops"]) == ["extra"]


def test_missing_day_is_an_error(spark, root):
    with pytest.raises(FileNotFoundError):
        static.read_static(spark, root, "stops", "2024-01-06")
    with pytest.raises(FileNotFoundError):
        static.read_static(spark, root, "stops", None, today=date(2024, 1, 6))
    assert static.read_static(spark, root, "stops", None, today=date(2024, 1, 5)).count() == 2


def test_feed_info(spark, root):
    info = static.read_feed_info(spark, f"{root}/2024/01/05/feed_info.txt").first()
    assert (info.feed_publisher_name, info.feed_version) == ("Lines, Inc.", "v1")
    assert static.read_feed_info(spark, f"{root}/none.txt").count() == 0


def test_archive_hash(spark, tmp_path):
    import hashlib
    (tmp_path / "a.zip").write_bytes(b"feed bytes")
    got = static.read_archives(spark, str(tmp_path / "a.zip")).first()
    assert got.feedhash == hashlib.sha256(b"feed bytes").hexdigest()


def test_schema_drift_append(spark):
    stored, incoming = frame(spark, "a string, b string", ("1", "2")), frame(spark, "a string, c string", ("3", "4"))
    assert rows(static.append_drifted(stored, incoming)) == [("1", "2", None), ("3", None, "4")]


def test_replace_partition_keeps_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    first = frame(spark, "d date, v int", (date(2024, 1, 1), 1), (date(2024, 1, 2), 2))
    sinks.replace_partition(first, path, "d")
    sinks.replace_partition(frame(spark, "d date, v int", (date(2024, 1, 2), 9)), path, "d")
    assert rows(spark.read.parquet(path), "d", "v") == [(date(2024, 1, 1), 1), (date(2024, 1, 2), 9)]
    read = spark.read.parquet(path)
    sinks.replace_partition(read.selectExpr("d", "v + 1 as v").filter("d = date '2024-01-01'"), path, "d")  # reads what it replaces
    assert rows(spark.read.parquet(path), "d", "v") == [(date(2024, 1, 1), 2), (date(2024, 1, 2), 9)]
    sinks.overwrite_table(first.limit(1), path)
    assert spark.read.parquet(path).count() == 1


def test_replace_days_removes_emptied_days(spark, tmp_path):
    path = str(tmp_path / "t")
    facts = frame(spark, "datekey int, v int", *[(d, d * 10) for d in (1, 2, 3, 4)])
    assert sinks.replace_days(facts, path, "datekey", facts) == []
    stored = sinks.read_table(spark, path, "datekey int, v int")
    wanted = frame(spark, "datekey int", (1,), (2,), (2,), (9,))
    assert sinks.replace_days(stored.filter("datekey = 2").selectExpr("datekey", "v + 1 as v"), path, "datekey", wanted) == [1]
    assert rows(sinks.read_table(spark, path, "datekey int, v int")) == [(2, 21), (3, 30), (4, 40)]
    assert sinks.replace_days(facts.limit(0), path, "datekey", facts) == [2, 3, 4]
    assert sinks.read_table(spark, path, "datekey int, v int").count() == 0


def test_write_day_skips_empty(spark, tmp_path):
    df = frame(spark, "agency_key string, service_date date, v int", ("a", date(2024, 1, 1), 1), ("b", date(2024, 1, 1), 2))
    path = str(tmp_path / "rt")
    day = date(2024, 1, 1)
    assert not sinks.write_day(df.limit(0), path, day)
    assert sinks.write_day(df, path, day) and sinks.write_day(df.filter("v = 1"), path, day)
    assert not sinks.write_day(df.limit(0), path, day)
    assert spark.read.parquet(path).count() == 2


def test_reports_and_extracts(spark, tmp_path):
    df = frame(spark, "table_name string, overall_passed boolean", ("trips", True))
    checks = quality.check_tables(spark, {"fare_rules": None, "stops": None})
    report = sinks.write_report(checks, str(tmp_path / "report"))
    assert rows(report) == rows(quality.verdicts(checks)) and spark.read.json(str(tmp_path / "report" / "summary")).count() == 1
    views = {name: df for name in sinks.EXTRACTS}
    assert sinks.refresh_extracts(views, str(tmp_path / "out")) == list(sinks.EXTRACTS)
    assert spark.read.parquet(str(tmp_path / "out" / "voms")).count() == 1
    assert sinks.read_table(spark, str(tmp_path / "absent"), FACT_SERVICE_DAY).count() == 0


def snapshot(ts, *entities, length=500):
    return {"length": length, "header": {"timestamp": ts}, "entity": list(entities)}


def trip_update(trip, *stops, direction=0, relationship=0):
    return {"trip_update": {"trip": {"trip_id": trip, "route_id": "", "direction_id": direction, "schedule_relationship": relationship}, "stop_time_update": list(stops)}}


def land(root, agency, feed, moment, body):
    folder = root / agency / feed / moment[:10]
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{moment[11:]}.json").write_text(json.dumps(body))


def test_feed_day(spark, tmp_path):
    ts = 1_704_182_400  # 2024-01-02 08:00 UTC, midnight on the west coast
    stop = {"stop_id": "s1", "stop_sequence": 1, "arrival": {"time": ts + 60, "delay": 5}, "departure": {"time": 0, "delay": 7}}
    bare = {"stop_id": "s2", "stop_sequence": 2}
    land(tmp_path, "north", "trip-updates", "2024/01/02/080000", snapshot(ts, trip_update("t1", stop, bare), trip_update("t2", direction=7, relationship=3)))
    land(tmp_path, "north", "trip-updates", "2024/01/02/080100", snapshot(ts, trip_update("t3", stop), length=20))
    land(tmp_path, "north", "trip-updates", "2024/01/03/080000", snapshot(ts))
    land(tmp_path, "south", "vehicle-positions", "2024/01/02/080000", snapshot(
        ts, {"vehicle": {"position": {"latitude": 1.0, "longitude": 2.0}, "current_stop_sequence": 0, "current_status": 1, "timestamp": ts - 1}},
        {"vehicle": {"trip": {"trip_id": "t1", "route_id": "r"}, "vehicle": {"id": "v"}, "position": {"latitude": 1.0, "longitude": 2.0}, "current_status": 9, "timestamp": 0}}))
    everything = feeds.read_feed(spark, str(tmp_path))
    assert rows(everything, "agency_key", "feed_type", "landed_date", "length")[0] == ("north", "trip-updates", date(2024, 1, 2), 20)
    assert feeds.list_snapshots(spark, str(tmp_path), "north", day="2024-01-02").count() == 2
    good = flatten.valid_snapshots(everything)
    updates = rows(flatten.flatten_trip_updates(good), "agency_key", "trip_id", "stop_id", "service_date", "arrival_delay", "arrival_time_utc",
                   "departure_delay", "departure_time_utc", "arrival_source", "route_id", "direction_id")
    assert updates == [
        ("north", "t1", "s1", date(2024, 1, 2), 5, ts + 60, 7, None, "GTFS_RT_REPORTED", None, 0),
        ("north", "t1", "s2", date(2024, 1, 2), None, None, None, None, "FALLBACK_SCHEDULED", None, 0),
    ]
    seen = flatten.flatten_vehicle_positions(good).collect()
    by_trip = {r.trip_id: r for r in seen}
    assert by_trip[None].timestamp_local.date() == date(2024, 1, 1) and by_trip[None].current_status == "STOPPED_AT"
    assert by_trip[None].current_stop_sequence is None and by_trip["t1"].timestamp_local is None and by_trip["t1"].current_status == "UNKNOWN"
    aged = flatten.with_feed_age(good, F.lit(ts + 301))
    assert {r.is_stale for r in aged.collect()} == {True}
