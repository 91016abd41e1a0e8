"""Decoded feed snapshots to staging rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flags
from ..functions.clock import DEFAULT_ZONE, local_time, service_day, utc_time
from ..functions.guards import blank_to_null
from ..schemas import STOP_UPDATES, VEHICLE_POSITIONS, conform

# Smallest size of a feed with content, and age after which it counts as stale.
MIN_FEED_BYTES = 100
STALE_SECONDS = 300


def valid_snapshots(feeds: DataFrame) -> DataFrame:
    """Snapshots large enough to hold data and with at least one entity."""
    return feeds.filter((F.col("length") >= MIN_FEED_BYTES) & (F.size("entity") > 0))


def with_feed_age(feeds: DataFrame, polled_at: Column | str, limit: int = STALE_SECONDS) -> DataFrame:
    """Age of each snapshot when polled (epoch seconds) and whether it is stale."""
    polled = F.col(polled_at) if isinstance(polled_at, str) else polled_at
    age = polled - F.col("header.timestamp")
    return feeds.withColumns({"feed_age": age, "is_stale": age > limit})


# What the feed format means by an absent enumeration.
SCHEDULED, IN_TRANSIT_TO = 0, 2


def _positive(value: Column) -> Column:
    return F.when(value > 0, value)


def flatten_trip_updates(feeds: DataFrame, zone: str = DEFAULT_ZONE, cutoff_hour: int = 0) -> DataFrame:
    """One row per stop time update; times absent or 0 are NULL.

    The service date is the feed's local day; before ``cutoff_hour`` it is the day before, which
    lets stops after midnight match the day their trip started.
    """
    entities = feeds.select(
        "agency_key", F.col("header.timestamp").alias("_feed"), F.explode("entity.trip_update").alias("_tu")
    ).filter(F.col("_tu").isNotNull())
    rows = entities.select(
        "agency_key", "_feed", F.col("_tu.trip").alias("_trip"), F.explode("_tu.stop_time_update").alias("_stu")
    )
    arrival = F.col("_stu.arrival")
    arrives = _positive(F.col("_stu.arrival.time"))
    departs = _positive(F.col("_stu.departure.time"))
    direction = F.coalesce("_trip.direction_id", F.lit(0))
    return conform(
        rows.select(
            "agency_key",
            F.col("_trip.trip_id").alias("trip_id"),
            blank_to_null("_trip.route_id").alias("route_id"),
            F.when(direction.isin(0, 1), direction).alias("direction_id"),
            flags.decode(flags.SCHEDULE_RELATIONSHIP, F.coalesce("_trip.schedule_relationship", F.lit(SCHEDULED))).alias("schedule_relationship"),
            service_day(local_time(F.col("_feed"), zone), cutoff_hour).alias("service_date"),
            F.col("_stu.stop_id").alias("stop_id"),
            F.col("_stu.stop_sequence").alias("stop_sequence"),
            F.col("_stu.arrival.delay").alias("arrival_delay"),
            arrives.alias("arrival_time_utc"),
            local_time(arrives, zone).alias("arrival_time_local"),
            F.col("_stu.departure.delay").alias("departure_delay"),
            departs.alias("departure_time_utc"),
            local_time(departs, zone).alias("departure_time_local"),
            utc_time("_feed").alias("feed_timestamp_utc"),
            F.when(arrival.isNotNull(), flags.REPORTED).otherwise(flags.FALLBACK).alias("arrival_source"),
        ),
        STOP_UPDATES,
    )


def flatten_vehicle_positions(feeds: DataFrame, zone: str = DEFAULT_ZONE) -> DataFrame:
    """One row per vehicle; absent trip, vehicle, sequence and time are NULL."""
    rows = feeds.select(
        "agency_key", F.col("header.timestamp").alias("_feed"), F.explode("entity.vehicle").alias("_v")
    ).filter(F.col("_v").isNotNull())
    seen = _positive(F.col("_v.timestamp"))
    return conform(
        rows.select(
            "agency_key",
            blank_to_null("_v.trip.trip_id").alias("trip_id"),
            blank_to_null("_v.trip.route_id").alias("route_id"),
            blank_to_null("_v.vehicle.id").alias("vehicle_id"),
            F.col("_v.position.latitude").alias("latitude"),
            F.col("_v.position.longitude").alias("longitude"),
            F.nullif(F.col("_v.current_stop_sequence"), F.lit(0)).alias("current_stop_sequence"),
            flags.decode(flags.VEHICLE_STATUS, F.coalesce("_v.current_status", F.lit(IN_TRANSIT_TO))).alias("current_status"),
            utc_time(seen).alias("timestamp_utc"),
            local_time(seen, zone).alias("timestamp_local"),
            utc_time("_feed").alias("feed_timestamp_utc"),
        ),
        VEHICLE_POSITIONS,
    )
