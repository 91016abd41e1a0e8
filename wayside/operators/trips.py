"""Trip fact: scheduled skeleton, ping merge, added trips, official flag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flags
from ..functions.clock import date_key, elapsed_seconds, gtfs_seconds, service_day
from ..functions.guards import is_int, non_blank, numeric_or_null
from ..functions.ratios import zero_key
from ..schemas import FACT_TRIP, conform
from .calendar import service_days
from .keys import fresh_key, new_rows_only, resolve_key, resolve_route, scope_to, version_key
from .latest import keep_latest
from .stops import service_calendar

Frames = Mapping[str, DataFrame]
TRIP_KEYS = ["tripkey", "datekey"]


def scheduled_trips(trips: DataFrame, services: DataFrame) -> DataFrame:
    """Trips whose service is active or cancelled on some date of the run."""
    return scope_to(trips, services, "service_id")


def shape_miles(shapes: DataFrame, trips: DataFrame | None = None) -> DataFrame:
    """Length of each shape in miles; with ``trips`` only shapes those trips use."""
    if trips is not None:
        shapes = scope_to(shapes, trips, "shape_id")
    length = F.max(numeric_or_null("shape_dist_traveled"))
    usable = shapes.filter(non_blank("shape_dist_traveled"))
    return usable.groupBy("shape_id").agg(length.alias("_metres")).select("shape_id", flags.miles("_metres").alias("miles"))


def trip_hours(stop_times: DataFrame, trips: DataFrame | None = None) -> DataFrame:
    """Hours from first arrival to last departure per trip, NULL where negative."""
    if trips is not None:
        stop_times = scope_to(stop_times, trips, "trip_id")
    usable = stop_times.filter(non_blank("arrival_time") & non_blank("departure_time") & is_int("stop_sequence"))
    bounds = usable.groupBy("trip_id").agg(
        F.min(gtfs_seconds("arrival_time")).alias("_first"), F.max(gtfs_seconds("departure_time")).alias("_last")
    )
    span = F.col("_last") - F.col("_first")
    return bounds.select("trip_id", F.when(span >= 0, flags.hours_of(span)).alias("hours"))


def trip_skeleton(
    stg: Frames, dims: Frames, dates: DataFrame, existing: DataFrame | None = None, force_skeleton: bool = False
) -> DataFrame:
    """One row per scheduled trip and date, cancelled trips included.

    ``force_skeleton`` ignores what is stored, so the result replaces those days outright. Miles,
    hours and keys are attached per trip; dates unfold last. Shapes and stop times combine per shape and
    trip before they move; restricting them to the trips of the run first would move every row.
    """
    days = service_days(stg["calendar"], stg["calendar_dates"], dates)
    services = service_calendar(days, "active or cancelled", "cancelled", "special")
    resolved = dims["trip"].filter("tripkey > 0").select(F.col("tripid").alias("trip_id"), "tripkey")
    trips = (
        stg["trips"].select("trip_id", "route_id", "service_id", "shape_id")
        .join(services, "service_id")
        .join(resolved, "trip_id")
    )
    trips = resolve_route(trips, dims["route"], dims["agency"])
    lengths = fresh_key(shape_miles(stg["shapes"]), "shape_id")
    trips = trips.join(lengths, "shape_id", "left").join(trip_hours(stg["stop_times"]), "trip_id", "left")
    rows = trips.withColumn("_day", F.explode("days"))
    cancelled = F.col("_day.cancelled")
    vrm, vrh = zero_key("miles"), zero_key("hours")
    skeleton = conform(
        rows.select(
            "tripkey",
            date_key("_day.service_date").alias("datekey"),
            "agencykey",
            "routekey",
            version_key(dims["feed_version"]).alias("versionkey"),
            F.when(cancelled, flags.CANCELLED).otherwise(flags.MISSED).alias("tripstatus"),
            F.when(cancelled, "CALENDAR").otherwise("INFERRED").alias("tripstatussource"),
            vrm.alias("scheduledvrm"),
            vrh.alias("scheduledvrh"),
            vrm.alias("reportedvrm"),
            vrh.alias("reportedvrh"),
            F.lit(True).alias("isestimated"),
            F.col("_day.special").alias("isspecialevent"),
            F.lit(False).alias("isofficial"),
        ),
        FACT_TRIP,
    )
    if existing is None or force_skeleton:
        return skeleton
    return new_rows_only(skeleton, existing, TRIP_KEYS)


def ping_summary(positions: DataFrame, keys: Sequence[str] = ("trip_id",), cutoff_hour: int = 0) -> DataFrame:
    """First ping, last ping and ping count per key and service day."""
    pings = positions.filter(non_blank("trip_id") & F.col("timestamp_local").isNotNull())
    pings = pings.withColumn("service_date", service_day("timestamp_local", cutoff_hour))
    return pings.groupBy(*keys, "service_date").agg(
        F.min("timestamp_local").alias("first_ping"),
        F.max("timestamp_local").alias("last_ping"),
        F.count(F.lit(1)).cast("int").alias("ping_count"),
    )


def _update(fact: DataFrame, source: DataFrame, apply, new_values: Mapping) -> DataFrame:
    """Left-join ``source`` on the trip keys and replace columns where ``apply`` holds."""
    joined = fact.join(source.withColumn("_matched", F.lit(True)), TRIP_KEYS, "left")
    joined = joined.withColumn("_apply", flags.is_true(F.col("_matched")) & flags.is_true(apply))
    return joined.select(
        *[
            F.when(F.col("_apply"), new_values[c]).otherwise(F.col(c)).alias(c) if c in new_values else F.col(c)
            for c in fact.columns
        ]
    )


def merge_pings(
    fact: DataFrame,
    positions: DataFrame,
    dims: Frames,
    force: bool = False,
    estimated_scope: bool = True,
    cutoff_hour: int = 0,
) -> DataFrame:
    """Turn missed trips with pings into operated ones.

    ``force`` also re-evaluates trips already operated; cancelled trips never change.
    ``estimated_scope`` is the estimated flag written to operated rows: true, because their miles
    stay the scheduled ones.
    """
    return merge_summary(fact, ping_summary(positions, cutoff_hour=cutoff_hour), dims, force, estimated_scope)


def merge_summary(fact: DataFrame, summary: DataFrame, dims: Frames, force: bool = False, estimated_scope: bool = True) -> DataFrame:
    """``merge_pings`` with the pings summed up already, per trip and service day."""
    trips = dims["trip"].select(F.col("tripid").alias("trip_id"), "tripkey")
    pings = summary.join(trips, "trip_id")
    source = pings.select(
        "tripkey",
        date_key("service_date").alias("datekey"),
        "first_ping",
        "last_ping",
        "ping_count",
        elapsed_seconds("first_ping", "last_ping").alias("_span"),
    )
    status = F.col("tripstatus")
    span = F.col("_span")
    return _update(
        fact,
        source,
        (status != flags.CANCELLED) if force else (status == flags.MISSED),
        {
            "tripstatus": F.lit(flags.OPERATED),
            "tripstatussource": F.lit("GTFS_RT"),
            "actualstarttime": F.col("first_ping"),
            "actualendtime": F.col("last_ping"),
            "tripendsource": F.lit("LAST_PING"),
            "actualpingcount": F.col("ping_count"),
            "expectedpingcount": flags.expected_pings(span),
            "rtcoveragerate": flags.rt_coverage("ping_count", span),
            "reportedvrm": F.col("scheduledvrm"),
            "reportedvrh": F.when(span > 0, flags.hours_of(span)).otherwise(F.col("scheduledvrh")),
            "isestimated": F.lit(estimated_scope),
        },
    )


def added_trips(
    positions: DataFrame,
    trips: DataFrame,
    dims: Frames,
    cutoff_hour: int = 0,
    added_vrm: str | None = "hours",
    agency_ids: DataFrame | None = None,
) -> DataFrame:
    """Trips seen in pings but absent from the timetable, with trip key 0.

    ``added_vrm='hours'`` stores the span in hours as miles too, as the source warehouse does;
    ``None`` leaves the miles empty. ``agency_ids`` (agency_key, agencyid) translates feed names
    of agencies to timetable ids; without it feed names are looked up as ids.
    """
    seen = ping_summary(positions, ("trip_id", "agency_key"), cutoff_hour)
    seen = seen.join(trips.select("trip_id"), "trip_id", "left_anti")
    if agency_ids is not None:
        seen = seen.join(agency_ids.select("agency_key", "agencyid"), "agency_key", "left")
        seen = seen.withColumn("agency_key", F.coalesce("agencyid", "agency_key")).drop("agencyid")
    seen = resolve_key(seen, dims["agency"], "agency_key", "agencyid", "agencykey")
    seen = seen.withColumn("_span", elapsed_seconds("first_ping", "last_ping"))
    hours = flags.hours_of("_span")
    return conform(
        seen.select(
            F.lit(0).alias("tripkey"),
            date_key("service_date").alias("datekey"),
            "agencykey",
            F.lit(0).alias("routekey"),
            version_key(dims["feed_version"]).alias("versionkey"),
            F.lit(flags.ADDED).alias("tripstatus"),
            F.lit("GTFS_RT").alias("tripstatussource"),
            F.col("first_ping").alias("actualstarttime"),
            F.col("last_ping").alias("actualendtime"),
            F.lit("LAST_PING").alias("tripendsource"),
            F.col("ping_count").alias("actualpingcount"),
            flags.expected_pings("_span").alias("expectedpingcount"),
            flags.rt_coverage("ping_count", "_span").alias("rtcoveragerate"),
            F.lit(0).alias("scheduledvrm"),
            F.lit(0).alias("scheduledvrh"),
            (hours if added_vrm == "hours" else F.lit(None)).alias("reportedvrm"),
            hours.alias("reportedvrh"),
            F.lit(True).alias("isestimated"),
            F.lit(False).alias("isspecialevent"),
            F.lit(False).alias("isofficial"),
            F.lit(flags.ADDED_FLAG).alias("dataqualityflag"),
        ),
        FACT_TRIP,
    )


def replace_added(fact: DataFrame, added: DataFrame) -> DataFrame:
    """Drop earlier added rows and put the fresh ones in."""
    return fact.filter(F.col("tripstatus") != flags.ADDED).unionByName(added)


def backfill_actual_times(fact: DataFrame, positions: DataFrame, dims: Frames, cutoff_hour: int = 0) -> DataFrame:
    """Set start and end of operated trips from pings and clear the estimated flag.

    Where several agencies report one trip, the latest last ping wins.
    """
    seen = ping_summary(positions, ("trip_id", "agency_key"), cutoff_hour)
    trips = dims["trip"].select(F.col("tripid").alias("trip_id"), "tripkey")
    keyed = seen.join(trips, "trip_id").select(
        "tripkey", date_key("service_date").alias("datekey"), "last_ping", "agency_key", "first_ping"
    )
    source = keep_latest(keyed, TRIP_KEYS, ["last_ping", "agency_key"]).drop("agency_key")
    return _update(
        fact,
        source,
        F.col("tripstatus") == flags.OPERATED,
        {
            "actualstarttime": F.col("first_ping"),
            "actualendtime": F.col("last_ping"),
            "isestimated": F.lit(False),
        },
    )


def trip_official(fact: DataFrame) -> DataFrame:
    """Recompute the official flag of every row; runs after all status changes."""
    flag = flags.is_official_trip("tripstatus", "reportedvrm", "reportedvrh", "dataqualityflag", "isestimated")
    return fact.withColumn("isofficial", flag)


def trip_profile(fact: DataFrame) -> DataFrame:
    """Row counts and averages by status and flags."""
    groups = ["datekey", "tripstatus", "tripstatussource", "isestimated", "isofficial", "isspecialevent"]
    return (
        fact.groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.round(F.avg("scheduledvrm"), 2).alias("avg_scheduled_vrm"),
            F.round(F.avg("scheduledvrh"), 2).alias("avg_scheduled_vrh"),
            F.count("actualpingcount").alias("trips_with_rt_data"),
            F.round(F.avg("rtcoveragerate"), 3).alias("avg_rt_coverage"),
        )
        .orderBy(*groups)
    )
