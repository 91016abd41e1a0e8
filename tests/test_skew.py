"""One key holding a third of all rows: results stay whole and the work is split."""

import pytest
from pyspark.sql import functions as F

from conftest import frame, rows
from wayside.operators import days, keys, latest, quality, stops, trips
from wayside.schemas import FACT_TRIP, STAGING_COLUMNS, conform
from wayside.sources.static import reconcile

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def no_broadcast(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    collected = df.collect()
    assert collected is not None
    return df._jdf.queryExecution().executedPlan().toString()


def hot_times(spark, n=60_000):
    """Stop times of which a third belong to trip t1, the rest to 2000 others."""
    i = F.col("id")
    trip = F.when(i % 3 == 0, "t1").otherwise(F.concat(F.lit("u"), (i % 2000).cast("string")))
    df = spark.range(0, n, 1, 8).select(
        trip.alias("trip_id"), F.lit("s1").alias("stop_id"), F.lit("08:00:00").alias("arrival_time"), F.lit("08:00:30").alias("departure_time"),
        i.cast("string").alias("stop_sequence"))
    return reconcile(df, STAGING_COLUMNS["stop_times"])


def test_hot_trip_is_split_across_tasks(spark, town, no_broadcast):
    stg = {**town.stg, "stop_times": hot_times(spark)}
    skeleton = stops.stop_skeleton(stg, town.dims, town.dates)
    assert "skew=true" in executed(skeleton)
    assert skeleton.filter("tripkey = 31 and datekey = 20240101").count() == 20_000
    ends = skeleton.filter("datekey = 20240101 and (isoriginstop or isterminalstop)")
    assert rows(ends, "stopsequence") == [(0,), (59_997,)]


def test_hot_trip_ends_are_split(spark, no_broadcast):
    marked = stops.mark_ends(stops.stop_visits(hot_times(spark)))
    assert "skew=true" in executed(marked)
    assert marked.count() == 60_000 and marked.filter("trip_id = 't1' and is_terminal").count() == 1


def test_hot_shape_and_service_are_split(spark, town, no_broadcast):
    i = F.col("id")
    many = spark.range(0, 60_000, 1, 8)
    hot = reconcile(many.select(
        i.cast("string").alias("trip_id"), F.lit("r1").alias("route_id"), F.when(i % 3 == 0, "week").otherwise(F.concat(F.lit("w"), i.cast("string"))).alias("service_id"),
        F.when(i % 3 == 0, "h1").otherwise(F.concat(F.lit("h"), i.cast("string"))).alias("shape_id")), STAGING_COLUMNS["trips"])
    dims = {**town.dims, "trip": many.select((i + 1).alias("tripkey"), i.cast("string").alias("tripid"))}
    fact = trips.trip_skeleton({**town.stg, "trips": hot}, dims, town.dates)
    assert "skew=true" in executed(fact)
    assert fact.filter("datekey = 20240101").count() == 20_000


def test_hot_stop_lookup_is_split(spark, no_broadcast):
    visits = hot_times(spark).select("trip_id", "stop_sequence")
    dim = spark.range(0, 2000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("tripid"), F.col("id").alias("tripkey"))
    dim = dim.union(frame(spark, "tripid string, tripkey bigint", ("t1", 7)))
    resolved = keys.resolve_key(visits, dim, "trip_id", "tripid", "tripkey")
    assert "skew=true" in executed(resolved)
    assert resolved.filter("tripkey = 7").count() >= 20_000


def test_hot_key_sends_one_row_per_task_to_keep_latest(spark, no_broadcast):
    df = hot_times(spark).select("trip_id", F.col("stop_sequence").cast("int").alias("seq"))
    kept = latest.keep_latest(df, ["trip_id"], ["seq"])
    assert kept.filter("trip_id = 't1'").first().seq == 59_997
    plan = executed(kept)
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_aggregates_combine_before_the_shuffle(spark, no_broadcast):
    for df in (trips.trip_hours(hot_times(spark)), stops.trip_ends(stops.stop_visits(hot_times(spark))), quality.duplicate_profile(hot_times(spark), ["trip_id"])):
        assert "partial_" in executed(df)
    assert rows(quality.duplicate_profile(hot_times(spark), ["trip_id"]))[0][0] == 60_000


def test_hot_day_peak(spark, no_broadcast):
    """Thousands of trips on one agency-day shuffle as at most 1441 changes per task."""
    n = 30_000
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    minute = (F.col("id") * 7 % 1400).cast("int")
    hot = F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 500).cast("int"))
    df = spark.range(0, n, 1, 4).select(
        F.col("id").alias("tripkey"), F.lit(20240101).alias("datekey"), hot.alias("agencykey"), F.lit("OPERATED").alias("tripstatus"),
        F.lit(False).alias("isspecialevent"), (start + F.make_dt_interval(F.lit(0), F.lit(0), minute)).alias("actualstarttime"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), minute + 30)).alias("actualendtime"))
    fact = conform(df, FACT_TRIP)
    expected = {}
    for i in range(0, n, 3):
        for m in range(i * 7 % 1400, i * 7 % 1400 + 31):
            expected[m] = expected.get(m, 0) + 1
    for i in range(n):
        if i % 3 and i % 500 == 1:
            for m in range(i * 7 % 1400, i * 7 % 1400 + 31):
                expected[m] = expected.get(m, 0) + 1
    peak = days.peak_vehicles(fact).filter("agencykey = 1").first()
    top = max(expected.values())
    assert (peak.peakvehiclecount, peak.peaktimekey) == (top, max(m for m, c in expected.items() if c == top))
