"""Stop fact: scheduled skeleton, real-time merge, official flag."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flags
from ..functions.clock import date_key, deviation_seconds, gtfs_minute_key, gtfs_seconds, month_of_key
from ..functions.guards import is_int, non_blank
from ..schemas import FACT_STOP, conform
from .calendar import service_days
from .keys import fresh_key, new_rows_only, resolve_key, resolve_route, version_key
from .latest import keep_latest

Frames = Mapping[str, DataFrame]
STOP_KEYS = ["tripkey", "stopkey", "stopsequence", "datekey"]
VISIT = ["tripkey", "stopkey", "stopsequence"]
VISIT_MONTH = [*VISIT, "_month"]


def stop_visits(stop_times: DataFrame) -> DataFrame:
    """Timetable rows with both times present and a numeric sequence, typed."""
    usable = non_blank("arrival_time") & non_blank("departure_time") & is_int("stop_sequence")
    return stop_times.filter(usable).select(
        "trip_id",
        "stop_id",
        F.col("stop_sequence").try_cast("int").alias("stop_sequence"),
        gtfs_seconds("arrival_time").alias("arr_secs"),
        gtfs_seconds("departure_time").alias("dep_secs"),
        gtfs_minute_key("arrival_time").alias("minute_key"),
    )


def trip_ends(visits: DataFrame) -> DataFrame:
    """First and last sequence per trip, combined before the shuffle."""
    return visits.groupBy("trip_id").agg(
        F.min("stop_sequence").alias("first_seq"), F.max("stop_sequence").alias("last_seq")
    )


def mark_ends(visits: DataFrame) -> DataFrame:
    """Flag the origin and terminal visit of each trip."""
    joined = visits.join(fresh_key(trip_ends(visits), "trip_id"), "trip_id")
    return joined.select(
        *visits.columns,
        (F.col("stop_sequence") == F.col("first_seq")).alias("is_origin"),
        (F.col("stop_sequence") == F.col("last_seq")).alias("is_terminal"),
    )


def active_trips(trips: DataFrame, services: DataFrame) -> DataFrame:
    """Trips per date of their active service."""
    return trips.join(services, "service_id").select("service_date", *trips.columns)


def service_calendar(days: DataFrame, condition: str, *details: str) -> DataFrame:
    """Per service the array of its dates (at most one entry per date of the run)."""
    entry = F.struct("service_date", *details)
    arrays = days.filter(condition).groupBy("service_id").agg(F.sort_array(F.collect_list(entry)).alias("days"))
    return fresh_key(arrays, "service_id")


def stop_skeleton(stg: Frames, dims: Frames, dates: DataFrame, existing: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """One scheduled row per stop visit, trip and date, for all ``dates`` in one job.

    Keys are resolved on timetable rows and trips, before dates multiply them; the trip carries
    its dates as an array through the one large join and unfolds after it, so the shuffle holds
    each timetable row once however long the range. Unresolved trips and stops are left out. With ``parts`` the
    rows come in that many partitions by visit, moved before dates multiply them, too.
    """
    services = service_calendar(service_days(stg["calendar"], stg["calendar_dates"], dates), "active")
    visits = stop_visits(stg["stop_times"])
    resolved = dims["trip"].filter("tripkey > 0").select(F.col("tripid").alias("trip_id"), "tripkey")
    trips = stg["trips"].select("trip_id", "route_id", "service_id").join(services, "service_id").join(resolved, "trip_id")
    trips = resolve_route(trips, dims["route"], dims["agency"]).join(trip_ends(visits), "trip_id")
    trips = fresh_key(trips, "trip_id")
    stops = dims["stop"].filter("stopkey > 0").select(F.col("stopid").alias("stop_id"), "stopkey")
    placed = resolve_key(visits.join(stops, "stop_id"), dims["time"], "minute_key", "timekey", "timekey")
    rows = placed.join(trips, "trip_id")
    if parts is not None:
        used = ("tripkey", "routekey", "stopkey", "timekey", "agencykey", "arr_secs", "dep_secs", "stop_sequence", "first_seq", "last_seq", "days")
        rows = rows.select(*used).repartition(parts, "tripkey", "stopkey", "stop_sequence")
    rows = rows.withColumn("service_date", F.explode("days.service_date"))
    skeleton = conform(
        rows.select(
            "tripkey",
            "routekey",
            "stopkey",
            date_key("service_date").alias("datekey"),
            "timekey",
            "agencykey",
            version_key(dims["feed_version"]).alias("versionkey"),
            F.col("arr_secs").alias("scheduledarrivalseconds"),
            F.col("dep_secs").alias("scheduleddepartureseconds"),
            F.col("stop_sequence").alias("stopsequence"),
            F.lit(flags.FALLBACK).alias("arrivalsource"),
            (F.col("stop_sequence") == F.col("first_seq")).alias("isoriginstop"),
            (F.col("stop_sequence") == F.col("last_seq")).alias("isterminalstop"),
            F.lit(False).alias("ismissed"),
            F.lit(True).alias("isestimated"),
            F.lit(False).alias("isofficial"),
        ),
        FACT_STOP,
    )
    return skeleton if existing is None else new_rows_only(skeleton, existing, STOP_KEYS)


def resolve_updates(updates: DataFrame, dims: Frames, parts: int | None = None) -> DataFrame:
    """Reported arrivals by fact key, one per key; with ``parts`` in that many partitions by visit.

    The few stops come first, so that rows move to their trips with a key in place of the stop's name and without unknown stops.
    Rows then move once more, by visit and month, for both keeping the newest and the join with the fact.
    """
    trips = dims["trip"].select(F.col("tripid").alias("trip_id"), "tripkey")
    stops = dims["stop"].select(F.col("stopid").alias("stop_id"), "stopkey")
    keyed = (
        updates.filter(F.col("arrival_time_local").isNotNull())
        .join(stops, "stop_id")
        .join(trips, "trip_id")
        .select(
            "tripkey",
            "stopkey",
            F.col("stop_sequence").cast("int").alias("stopsequence"),
            month_of_key(date_key("service_date")).alias("_month"),
            F.col("service_date").alias("_date"),
            "feed_timestamp_utc",
            "agency_key",
            F.col("arrival_time_local").alias("_arrival"),
            F.col("departure_time_local").alias("_departure"),
        )
    )
    moved = keyed.repartition(*VISIT_MONTH) if parts is None else keyed.repartition(parts, *VISIT)
    latest = keep_latest(moved, [*VISIT_MONTH, "_date"], ["feed_timestamp_utc", "agency_key"])
    return latest.select(*VISIT_MONTH, date_key("_date").alias("datekey"), "_date", "_arrival", "_departure")


def join_updates(fact: DataFrame, resolved: DataFrame) -> DataFrame:
    """Fact rows with the resolved report of their key, if any.

    Both sides move by visit and month instead of the whole key, so that the days of a visit, alike but for the date, stay next to
    each other and compress. The day is compared inside the join: at most 31 of a side meet, whatever the range. It is written as a difference
    because Spark would move rows by any plain equality.
    """
    reports = resolved.withColumnRenamed("datekey", "_day")
    same_day = (F.col("datekey") - F.col("_day")) == 0
    left = fact.withColumn("_month", month_of_key("datekey")).alias("f")
    on = [F.col(f"f.{c}") == F.col(f"r.{c}") for c in VISIT_MONTH]
    joined = left.join(reports.alias("r"), [*on, same_day], "left")
    return joined.select(*[F.col(f"f.{c}") for c in fact.columns], "_date", "_arrival", "_departure")


def join_in_place(fact: DataFrame, resolved: DataFrame) -> DataFrame:
    """``join_updates`` where both sides already lie in the same number of partitions by visit: neither moves.

    Only the reports of a partition, one per visit and day, are held in memory; the fact, several times their size, is not sorted.
    """
    on = [F.col(f"f.{c}") == F.col(f"r.{c}") for c in STOP_KEYS]
    joined = fact.alias("f").join(resolved.alias("r").hint("shuffle_hash"), on, "left")
    return joined.select(*[F.col(f"f.{c}") for c in fact.columns], "_date", "_arrival", "_departure")


def merge_stop_updates(fact: DataFrame, updates: DataFrame, dims: Frames, force: bool = False, parts: int | None = None) -> DataFrame:
    """Fact rows with reported arrivals and on-time flags filled in.

    Without ``force`` only rows still on the schedule fallback change. Days without updates pass
    through, so the result replaces the same partitions. ``parts`` says that the fact lies in so many partitions by visit.
    """
    resolved = resolve_updates(updates, dims, parts)
    joined = join_updates(fact, resolved) if parts is None else join_in_place(fact, resolved)
    apply = F.col("_date").isNotNull()
    if not force:
        apply = apply & flags.is_true(F.col("arrivalsource") == flags.FALLBACK)
    dev = deviation_seconds("_date", "scheduledarrivalseconds", "_arrival")
    staged = joined.withColumns({"_apply": apply, "_dev": dev})
    new_values = {
        "actualarrival": F.col("_arrival"),
        "actualdeparture": F.col("_departure"),
        "arrivaldevseconds": F.col("_dev"),
        "arrivalsource": F.lit(flags.REPORTED),
        "isontime": flags.on_time("_dev"),
        "isearly": flags.early("_dev"),
        "islate": flags.late("_dev"),
        "isestimated": F.lit(False),
    }
    return staged.select(
        *[
            F.when(F.col("_apply"), new_values[c]).otherwise(F.col(c)).alias(c) if c in new_values else F.col(c)
            for c in fact.columns
        ]
    )


def stop_official(fact: DataFrame) -> DataFrame:
    """Recompute the official flag of every row."""
    flag = flags.is_official_stop("isontime", "ismissed", "isoriginstop", "isterminalstop")
    return fact.withColumn("isofficial", flag)


def stop_profile(fact: DataFrame) -> DataFrame:
    """Row counts by arrival source and flags."""
    groups = ["datekey", "arrivalsource", "isofficial", "isontime"]
    return fact.groupBy(*groups).agg(F.count(F.lit(1)).alias("row_count")).orderBy(*groups)
