from datetime import date, datetime

import pytest

from conftest import frame, rows
from wayside.operators import audit, quality
from wayside.schemas import DIMENSIONS, conform


def test_table_checks(town):
    checks = quality.check_tables(town.spark, {**town.stg, "fare_rules": None})
    got = {(t, c): (f, p) for t, c, f, _, p in rows(checks)}
    assert got["stop_times", "duplicate_checks"] == (0, True)
    assert got["stop_times", "departure_time_format"] == (0, True)
    assert got["calendar", "null_checks"] == (0, True)
    assert got["fare_rules", "load"] == (1, False)
    verdicts = quality.verdicts(checks)
    passed = dict(rows(verdicts, "table_name", "overall_passed"))
    assert not passed.pop("fare_rules") and all(passed.values())
    summary = quality.summary(verdicts).first()
    assert (summary.total_tables, summary.failed, summary.failed_tables, summary.must_stop) == (10, 1, "fare_rules", False)
    quality.require_no_critical(verdicts)


def test_failures_are_found(spark):
    times = frame(spark, "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence string",
                  ("a", "1", "8:00:00", "s", "1"), ("a", "1", "8h", "s", "1"), (None, "1", None, "s", "2"), (None, "1", "30:00:00", None, "2"))
    got = {c: (f, n) for _, c, f, n, _ in rows(quality.check_table(times, "stop_times"))}
    assert got == {"row_counts": (0, 4), "required_columns": (0, 4), "null_checks": (4, 4), "departure_time_format": (1, 4), "duplicate_checks": (2, 4)}
    with pytest.raises(ValueError, match="stop_times"):
        quality.require_no_critical(quality.verdicts(quality.check_table(times, "stop_times")))


def test_missing_columns_and_empty_table(spark):
    trips = frame(spark, "route_id string, service_id string", ("r", "s"))
    assert quality.check_columns(trips, "trips") == ["trip_id"]
    got = {c: p for _, c, _, _, p in rows(quality.check_table(trips, "trips"))}
    assert got == {"row_counts": True, "required_columns": False, "null_checks": False, "duplicate_checks": False}
    empty = {c: p for _, c, _, _, p in rows(quality.check_table(trips.limit(0), "trips"))}
    assert not empty["row_counts"] and not empty["null_checks"]
    shapes = frame(spark, "shape_id string, shape_pt_lat string, shape_pt_lon string, shape_pt_sequence string").limit(0)
    empty = {c: p for _, c, _, _, p in rows(quality.check_table(shapes, "shapes"))}
    assert not empty["row_counts"] and empty["duplicate_checks"]


def test_nulls_of_all_key_columns_move_as_one_count(spark):
    ddl = "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence string"
    times = spark.createDataFrame([("a", "1:00:00", None, None, "1"), ("a", "1:00:00", "1:00:00", "s", "2"), (None, None, "x", "s", None)], ddl)
    checks = quality.check_table(times, "stop_times")
    assert {r.check_name: r.failing for r in checks.collect()}["null_checks"] == 4
    moved = [line for line in checks._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines() if "partial_" in line]
    assert max(line.count("partial_") for line in moved) <= 4


def test_profiles(spark):
    df = frame(spark, "a string, b string", ("1", None), ("1", None), (None, "8:00:00"), (None, "x"))
    assert rows(quality.null_profile(df, ["a", "b"])) == [("a", 2), ("b", 2)]
    assert rows(quality.duplicate_profile(df, ["a", "b"])) == [(4, 3, 1)]
    assert rows(quality.format_profile(df, "b")) == [(4, 1)]
    assert rows(quality.format_samples(df, "b")) == [("x",)]


def test_references(town):
    got = {(c, k): n for c, k, _, n in rows(quality.reference_checks(town.stg))}
    assert got == {("trips", "route_id"): 1, ("stop_times", "trip_id"): 1, ("stop_times", "stop_id"): 1, ("routes", "agency_id"): 0}


def test_preflight(town):
    quality.preflight(town.dims, "trip", "shape")
    with pytest.raises(ValueError, match="trip"):
        quality.preflight({**town.dims, "trip": town.dims["trip"].filter("tripkey = 0")}, "trip", "shape")
    silent = quality.days_without_pings(town.pings(("t1", datetime(2024, 1, 3, 8))), town.dates)
    assert silent.count() == 6


def versions(spark, *entries):
    return conform(frame(spark, "versionkey int, feedhash string, ingestedat timestamp_ntz, iscurrent boolean", *entries), DIMENSIONS["feed_version"])


def feed(spark, *entries):
    return frame(spark, "feedhash string, ingestedat timestamp_ntz", *entries)


def test_version_registry(spark):
    stored = versions(spark, (1, "aa", datetime(2024, 1, 1), False), (4, "bb", datetime(2024, 1, 2), True))
    known = audit.register_feed_version(stored, feed(spark, ("aa", datetime(2024, 1, 9))))
    assert rows(known, "versionkey", "feedhash", "iscurrent") == [(1, "aa", False), (4, "bb", True)]
    fresh = audit.register_feed_version(stored, feed(spark, ("cc", datetime(2024, 1, 9))))
    assert rows(fresh, "versionkey", "feedhash", "iscurrent") == [(1, "aa", False), (4, "bb", False), (5, "cc", True)]
    assert audit.is_new_version(feed(spark, ("bb", datetime(2024, 1, 9))), stored).count() == 0
    first = audit.register_feed_version(stored.limit(0), feed(spark, ("cc", datetime(2024, 1, 9))))
    assert rows(first, "versionkey", "iscurrent") == [(1, True)]


def test_manifest_fallback(spark):
    manifests = frame(spark, "feed_key string, load_date date, feed_hash string, is_new_version boolean",
                      ("f", date(2024, 1, 1), "a", True), ("f", date(2024, 1, 3), "b", True), ("f", date(2024, 1, 5), "c", True))
    got = audit.latest_manifest(manifests, "2024-01-05").first()
    assert (got.feed_hash, got.fallback_date, got.is_new_version, got.fallback) == ("b", date(2024, 1, 3), False, True)


def test_digest_headlines(spark):
    runs = frame(spark, "run_date date, run_timestamp timestamp_ntz, status string, is_new_version boolean, file_count int, error string",
                 (date(2024, 1, 1), datetime(2024, 1, 1, 5), "FAILED", False, 0, "x"), (date(2024, 1, 1), datetime(2024, 1, 1, 6), "SUCCEEDED", True, 9, None),
                 (date(2024, 1, 2), datetime(2024, 1, 2, 5), "SUCCEEDED", False, 9, None), (date(2024, 1, 3), datetime(2024, 1, 3, 5), "FAILED", False, 0, "x"))
    checks = frame(spark, "run_date date, overall_passed boolean, passed int, total_tables int",
                   (date(2024, 1, 1), True, 12, 12), (date(2024, 1, 2), False, 11, 12), (date(2024, 1, 3), True, 12, 12))
    used = frame(spark, "run_date date, fallback_date date", (date(2024, 1, 3), date(2024, 1, 2)))
    seen = frame(spark, "last_seen_date date, feedhash string", (date(2024, 1, 1), "0123456789abcdef"))
    days = frame(spark, "run_date date", *[(date(2024, 1, d),) for d in (1, 2, 3, 4, 4)])
    digest = audit.daily_digest(runs, checks, used, seen, days).orderBy("run_date")
    got = [tuple(row) for row in digest.select("headline", "feed_hash", "fallback_used").collect()]
    assert got == [("OK", "0123456789abcdef", False), ("ISSUES", "UNKNOWN", False), ("FAILED", "UNKNOWN", True), ("FAILED", "UNKNOWN", False)]
