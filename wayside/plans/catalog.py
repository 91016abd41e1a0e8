"""Named queries: each operator applied to the bundled tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions import clock, flags, guards
from ..operators import audit, calendar, days, dims, flatten, gaps, keys, latest, quality, stops, trips
from ..schemas import DIMENSIONS, FACT_STOP, FACT_TRIP, conform
from ..session import configure, scratch_path
from ..sources import evolve, feeds, sinks
from ..sources.static import append_drifted, list_files, reconcile
from ..streaming import alarms, facts, streams
from . import extracts, ledger, reports, views
from .daily import Options, Warehouse
from .lens import AS_OF, FIRST_DAY, LAST_DAY, Lens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison across engines."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType) else F.col(f.name)
        for f in df.schema.fields
    ])


def query(build: Callable[[Lens], DataFrame]) -> Callable[[Lens], DataFrame]:
    """Register a query under its function name."""
    QUERIES[build.__name__] = lambda spark, folder: plain(build(Lens(configure(spark), folder)))
    return build


# ---- scalar functions


@query
def gtfs_time_seconds(t: Lens) -> DataFrame:
    return t.stop_times.select(
        "trip_id", "stop_id", "stop_sequence",
        clock.gtfs_seconds("arrival_time").alias("arrival_seconds"),
        clock.gtfs_seconds("departure_time").alias("departure_seconds"),
        clock.gtfs_minute_key("arrival_time").alias("minute_key"),
        guards.is_int("stop_sequence").alias("numeric_sequence"),
        guards.is_gtfs_time("arrival_time").alias("valid_time"),
        guards.non_blank("arrival_time").alias("has_arrival"),
    )


@query
def date_and_minute_keys(t: Lens) -> DataFrame:
    ts = F.col("ts")
    key = clock.date_key(ts.cast("date"))
    return t.table("events").select(
        "event_id",
        clock.minute_of_day(ts).alias("minute_of_day"),
        clock.local_day(ts).alias("local_day"),
        clock.service_day(ts, 3).alias("service_day_cutoff_3"),
        key.alias("datekey"),
        clock.date_from_key(key).alias("date_again"),
        clock.gtfs_date(key.cast("string")).alias("gtfs_date"),
        clock.gtfs_date(F.concat(key.cast("string"), F.lit("x"))).alias("bad_date"),
        clock.since(ts.cast("date"), AS_OF, 10).alias("recent"),
        clock.default_day(AS_OF).alias("default_day"),
    )


@query
def local_times(t: Lens) -> DataFrame:
    epoch = clock.epoch_second("ts")
    local = clock.local_time(epoch)
    return t.table("events").select(
        "event_id", epoch.alias("epoch"), clock.utc_time(epoch).alias("utc_time"), local.alias("local_time"),
        local.cast("date").alias("local_date"),
    )


@query
def scheduled_and_deviation(t: Lens) -> DataFrame:
    day = F.col("ts").cast("date")
    seconds = (F.col("user_id") * 700).cast("int")
    return t.table("events").select(
        "event_id",
        clock.scheduled_instant(day, seconds).alias("scheduled"),
        clock.deviation_seconds(day, seconds, "ts").alias("deviation"),
        clock.elapsed_seconds(clock.scheduled_instant(day, seconds), F.col("ts")).alias("elapsed"),
    )


@query
def enum_labels(t: Lens) -> DataFrame:
    code = (F.col("user_id") % 5).cast("int")
    return t.table("events").groupBy(
        flags.decode(flags.SCHEDULE_RELATIONSHIP, code).alias("relationship"),
        flags.decode(flags.VEHICLE_STATUS, code).alias("vehicle_status"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def rt_coverage_rates(t: Lens) -> DataFrame:
    pings = trips.ping_summary(t.positions)
    span = clock.elapsed_seconds("first_ping", "last_ping")
    return pings.select(
        "trip_id", "service_date", "ping_count", span.alias("span"),
        flags.expected_pings(span).alias("expected"),
        flags.rt_coverage(F.col("ping_count") * 300, span).alias("coverage"),
        flags.hours_of(span).alias("hours"),
    )


# ---- services and trips


@query
def active_services(t: Lens) -> DataFrame:
    return calendar.active_services(t.calendar, t.calendar_dates, t.dates)


@query
def service_day_flags(t: Lens) -> DataFrame:
    return calendar.service_days(t.calendar, t.calendar_dates, t.dates)


@query
def cancelled_and_special_services(t: Lens) -> DataFrame:
    cancelled = calendar.cancelled_services(t.calendar_dates, t.dates).withColumn("kind", F.lit("cancelled"))
    special = calendar.special_services(t.calendar, t.calendar_dates, t.dates).withColumn("kind", F.lit("special"))
    return cancelled.unionByName(special)


@query
def active_trips(t: Lens) -> DataFrame:
    services = calendar.active_services(t.calendar, t.calendar_dates, t.dates)
    return stops.active_trips(t.trips, services).select("service_date", "trip_id", "route_id", "service_id", "shape_id")


@query
def scheduled_trips_semi(t: Lens) -> DataFrame:
    active = calendar.active_services(t.calendar, t.calendar_dates, t.dates)
    cancelled = calendar.cancelled_services(t.calendar_dates, t.dates)
    services = calendar.scheduled_services(active, cancelled)
    return trips.scheduled_trips(t.trips, services).select("trip_id", "service_id")


# ---- stop fact


@query
def stop_visits_origin_terminal(t: Lens) -> DataFrame:
    return stops.mark_ends(stops.stop_visits(t.stop_times))


SKELETON = [
    "tripkey", "routekey", "stopkey", "datekey", "timekey", "agencykey", "versionkey", "scheduledarrivalseconds",
    "scheduleddepartureseconds", "stopsequence", "arrivalsource", "isoriginstop", "isterminalstop", "isestimated",
    "isofficial",
]


@query
def stop_skeleton_zero_keys(t: Lens) -> DataFrame:
    return stops.stop_skeleton(t.timetable, t.dims, t.dates).select(*SKELETON)


@query
def skeleton_idempotent_anti(t: Lens) -> DataFrame:
    existing = stops.stop_skeleton(t.timetable, t.dims, t.dates).filter(F.col("stopsequence") <= 3)
    return stops.stop_skeleton(t.timetable, t.dims, t.dates, existing).select(*stops.STOP_KEYS)


@query
def stop_updates_keep_latest(t: Lens) -> DataFrame:
    rows = t.stop_updates.withColumn("stop_id", F.concat(F.lit("Q"), F.col("stop_sequence").cast("string")))
    rows = rows.select(
        "agency_key", "trip_id", "stop_id", "stop_sequence", "service_date", "feed_timestamp_utc", "arrival_time_local"
    )
    return latest.keep_latest(rows, ["agency_key", "trip_id", "stop_id", "stop_sequence", "service_date"], ["feed_timestamp_utc"])


@query
def positions_keep_latest(t: Lens) -> DataFrame:
    hour = F.make_timestamp_ntz(
        F.year("timestamp_utc"), F.month("timestamp_utc"), F.dayofmonth("timestamp_utc"), F.hour("timestamp_utc"),
        F.lit(0), F.lit(0),
    )
    rows = t.positions.withColumn("timestamp_utc", hour).select(
        "agency_key", "vehicle_id", "timestamp_utc", "feed_timestamp_utc", "trip_id", "latitude"
    )
    return latest.keep_latest(rows, ["agency_key", "vehicle_id", "timestamp_utc"], ["feed_timestamp_utc"])


MERGED = [
    *stops.STOP_KEYS, "actualarrival", "actualdeparture", "arrivaldevseconds", "arrivalsource", "isontime", "isearly",
    "islate", "isestimated", "isofficial",
]


@query
def stop_merge_otp_flags(t: Lens) -> DataFrame:
    skeleton = stops.stop_skeleton(t.timetable, t.dims, t.dates)
    return stops.merge_stop_updates(skeleton, t.stop_updates, t.dims).select(*MERGED)


def _partly_merged(t: Lens) -> DataFrame:
    """Skeleton whose first two visits count as reported already."""
    skeleton = stops.stop_skeleton(t.timetable, t.dims, t.dates)
    source = F.when(F.col("stopsequence") <= 2, flags.REPORTED).otherwise(F.col("arrivalsource"))
    return skeleton.withColumn("arrivalsource", source)


@query
def stop_merge_unforced(t: Lens) -> DataFrame:
    return stops.merge_stop_updates(_partly_merged(t), t.stop_updates, t.dims).select(*MERGED)


@query
def stop_merge_forced(t: Lens) -> DataFrame:
    return stops.merge_stop_updates(_partly_merged(t), t.stop_updates, t.dims, force=True).select(*MERGED)


@query
def stop_official(t: Lens) -> DataFrame:
    skeleton = stops.stop_skeleton(t.timetable, t.dims, t.dates)
    fact = stops.stop_official(stops.merge_stop_updates(skeleton, t.stop_updates, t.dims))
    return fact.groupBy("datekey", "routekey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("isofficial").alias("official"), F.count_if("isontime").alias("ontime")
    )


@query
def stop_fact_profile(t: Lens) -> DataFrame:
    return stops.stop_profile(stops.stop_official(t.fact_stop))


# ---- trip fact


@query
def trip_scheduled_miles(t: Lens) -> DataFrame:
    return trips.shape_miles(t.shapes, t.trips)


@query
def trip_scheduled_hours(t: Lens) -> DataFrame:
    return trips.trip_hours(t.stop_times, t.trips)


TRIP_SKELETON = [
    "tripkey", "datekey", "agencykey", "routekey", "versionkey", "tripstatus", "tripstatussource", "scheduledvrm",
    "scheduledvrh", "reportedvrm", "reportedvrh", "isestimated", "isspecialevent", "isofficial",
]


@query
def trip_skeleton_status(t: Lens) -> DataFrame:
    return trips.trip_skeleton(t.timetable, t.dims, t.dates).select(*TRIP_SKELETON)


@query
def trip_skeleton_forced(t: Lens) -> DataFrame:
    """What a normal and a forced skeleton insert when every stored trip is there already."""
    existing = trips.trip_skeleton(t.timetable, t.dims, t.dates)
    normal = trips.trip_skeleton(t.timetable, t.dims, t.dates, existing).withColumn("mode", F.lit("normal"))
    forced = trips.trip_skeleton(t.timetable, t.dims, t.dates, existing, True).withColumn("mode", F.lit("forced"))
    return normal.unionByName(forced).groupBy("mode", "tripstatus").agg(F.count(F.lit(1)).alias("n"))


PINGED = [
    "tripkey", "datekey", "tripstatus", "tripstatussource", "actualstarttime", "actualendtime", "tripendsource",
    "actualpingcount", "expectedpingcount", "rtcoveragerate", "reportedvrm", "reportedvrh", "isestimated",
]


@query
def trip_ping_merge(t: Lens) -> DataFrame:
    return trips.merge_pings(trips.trip_skeleton(t.timetable, t.dims, t.dates), t.positions, t.dims).select(*PINGED)


@query
def trip_ping_merge_forced(t: Lens) -> DataFrame:
    stored = trips.trip_skeleton(t.timetable, t.dims, t.dates)
    status = F.when((F.col("tripstatus") == flags.MISSED) & (F.col("tripkey") % 2 == 0), flags.OPERATED)
    stored = stored.withColumn("tripstatus", status.otherwise(F.col("tripstatus")))
    return trips.merge_pings(stored, t.positions, t.dims, force=True).select(*PINGED)


@query
def added_trips(t: Lens) -> DataFrame:
    added = trips.added_trips(t.positions, t.trips, t.dims)
    return added.select(*PINGED, "agencykey", "routekey", "versionkey", "scheduledvrm", "scheduledvrh", "isofficial", "dataqualityflag")


@query
def trip_official(t: Lens) -> DataFrame:
    fact = trips.merge_pings(trips.trip_skeleton(t.timetable, t.dims, t.dates), t.positions, t.dims)
    fact = trips.replace_added(fact, trips.added_trips(t.positions, t.trips, t.dims))
    return trips.trip_official(fact).groupBy("datekey", "agencykey", "tripstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("isofficial").alias("official")
    )


@query
def backfill_actual_times(t: Lens) -> DataFrame:
    fact = trips.trip_skeleton(t.timetable, t.dims, t.dates)
    status = F.when(F.col("tripstatus") == flags.MISSED, flags.OPERATED).otherwise(F.col("tripstatus"))
    fact = fact.withColumn("tripstatus", status)
    return trips.backfill_actual_times(fact, t.positions, t.dims).select(
        "tripkey", "datekey", "tripstatus", "actualstarttime", "actualendtime", "isestimated"
    )


@query
def trip_fact_profile(t: Lens) -> DataFrame:
    return trips.trip_profile(trips.trip_official(t.fact_trip))


# ---- service day


@query
def active_vehicles_per_minute(t: Lens) -> DataFrame:
    return days.active_per_minute(t.fact_trip)


@query
def active_vehicles_clock_rule(t: Lens) -> DataFrame:
    return days.active_per_minute(t.fact_trip, overnight="clock")


@query
def voms_peak_by_day(t: Lens) -> DataFrame:
    return days.peak_vehicles(t.fact_trip)


@query
def service_day_rollup(t: Lens) -> DataFrame:
    return days.service_day(t.fact_trip)


@query
def service_day_from_timetable(t: Lens) -> DataFrame:
    """Calendar to service-day fact in one plan."""
    fact = trips.merge_pings(trips.trip_skeleton(t.timetable, t.dims, t.dates), t.positions, t.dims)
    fact = trips.replace_added(fact, trips.added_trips(t.positions, t.trips, t.dims))
    return days.service_day(trips.trip_official(fact))


@query
def day_fact_profile(t: Lens) -> DataFrame:
    return days.day_profile(days.service_day(t.fact_trip))


# ---- views


@query
def otp_by_route_month(t: Lens) -> DataFrame:
    return views.otp_by_route_month(stops.stop_official(t.fact_stop), t.dims)


@query
def daily_otp_summary(t: Lens) -> DataFrame:
    return views.daily_otp_summary(stops.stop_official(t.fact_stop), t.dims)


@query
def routes_consistently_late(t: Lens) -> DataFrame:
    return views.routes_consistently_late(stops.stop_official(t.fact_stop), t.dims, None)


@query
def quality_daily(t: Lens) -> DataFrame:
    return views.quality_daily(stops.stop_official(t.fact_stop), t.dims)


@query
def missed_trip_rate_by_route(t: Lens) -> DataFrame:
    return views.missed_rate_by_route(t.fact_trip, t.dims)


def _voms(t: Lens) -> DataFrame:
    return views.voms(days.service_day(t.fact_trip), t.dims)


@query
def voms_month_fiscal_peaks(t: Lens) -> DataFrame:
    return _voms(t)


@query
def revenue_hours_daily(t: Lens) -> DataFrame:
    return views.daily_hours(days.service_day(t.fact_trip), t.dims)


@query
def revenue_miles_daily(t: Lens) -> DataFrame:
    return views.daily_miles(days.service_day(t.fact_trip), t.dims)


@query
def quality_alerts(t: Lens) -> DataFrame:
    return views.quality_alerts(days.service_day(t.fact_trip), t.dims)


@query
def missed_trip_trend(t: Lens) -> DataFrame:
    return views.missed_trend(days.service_day(t.fact_trip), t.dims)


@query
def monthly_ntd_summary(t: Lens) -> DataFrame:
    return views.monthly_ntd(days.service_day(t.fact_trip), t.dims)


# ---- dashboards


@query
def voms_line_by_month(t: Lens) -> DataFrame:
    return reports.voms_by_month_and_agency(_voms(t))


@query
def voms_bar_by_mode(t: Lens) -> DataFrame:
    return reports.voms_by_mode(_voms(t))


@query
def voms_bar_by_period(t: Lens) -> DataFrame:
    return reports.voms_by_period(_voms(t))


@query
def voms_table_detail(t: Lens) -> DataFrame:
    return reports.voms_detail(_voms(t))


@query
def kpi_month_over_month(t: Lens) -> DataFrame:
    return reports.month_over_month(_voms(t), "monthly_voms", by=["agencyname"])


def _alerts(t: Lens) -> DataFrame:
    return views.quality_alerts(days.service_day(t.fact_trip), t.dims)


@query
def coverage_kpi(t: Lens) -> DataFrame:
    return reports.coverage_kpi(reports.for_agencies(_alerts(t), None), by=["agencyname"])


@query
def alert_table(t: Lens) -> DataFrame:
    return reports.alert_table(reports.for_agencies(_alerts(t), ["AFRICA", "ASIA"]))


@query
def alert_bars(t: Lens) -> DataFrame:
    return reports.alert_bars(_alerts(t))


def _daily(t: Lens) -> DataFrame:
    return views.daily_otp_summary(stops.stop_official(t.fact_stop), t.dims)


@query
def daily_otp_trend(t: Lens) -> DataFrame:
    return reports.otp_trend(_daily(t))


@query
def daily_volume(t: Lens) -> DataFrame:
    return reports.daily_volume(_daily(t))


@query
def weekday_weekend_volume(t: Lens) -> DataFrame:
    return reports.weekday_volume(_daily(t))


@query
def top10_routes(t: Lens) -> DataFrame:
    return reports.top_routes(views.otp_by_route_month(stops.stop_official(t.fact_stop), t.dims))


@query
def top10_route_otp(t: Lens) -> DataFrame:
    return reports.top_route_otp(views.otp_by_route_month(stops.stop_official(t.fact_stop), t.dims))


# ---- sinks and runs


@query
def extract_roundtrip(t: Lens) -> DataFrame:
    """A view through its served copy."""
    out, name = scratch_path(t.spark, "extracts"), "missed_rate_by_route"
    sinks.refresh_extracts({name: views.missed_rate_by_route(t.fact_trip, t.dims)}, out, (name,))
    return t.spark.read.parquet(f"{out}/{name}")


@query
def extract_changed_days(t: Lens) -> DataFrame:
    """The served copy of a view after days that were loaded in part have been loaded again; only these are recomputed."""
    fact, out, name = scratch_path(t.spark, "fact-trip"), scratch_path(t.spark, "extracts"), "missed_rate_by_route"
    whole = t.fact_trip
    sinks.replace_partition(whole.filter("datekey % 5 <> 0 or tripstatus = 'MISSED'"), fact, "datekey")
    extracts.refresh_changed(t.spark, {"trip": fact}, t.dims, out, [name])
    again = whole.filter("datekey % 5 = 0")
    sinks.replace_days(again, fact, "datekey", again)
    extracts.refresh_changed(t.spark, {"trip": fact}, t.dims, out, [name])
    return extracts.served(t.spark, out, name)


@query
def replace_day_roundtrip(t: Lens) -> DataFrame:
    """Even date keys replaced by their missed trips on every second of them, and by nothing on the others."""
    path, facts = scratch_path(t.spark, "replaced"), t.fact_trip
    sinks.replace_days(facts, path, "datekey", facts)
    stored = sinks.read_table(t.spark, path, FACT_TRIP)
    even = stored.filter("datekey % 2 = 0")
    sinks.replace_days(even.filter("datekey % 4 = 0 and tripstatus = 'MISSED'"), path, "datekey", even)
    return sinks.read_table(t.spark, path, FACT_TRIP).groupBy("datekey").agg(F.count(F.lit(1)).alias("n"))


@query
def range_backfill(t: Lens) -> DataFrame:
    """Service days of a stored warehouse, filled in two parts."""
    house = Warehouse(t.spark, scratch_path(t.spark, "house"))
    shapes = dims.dim_shape(t.shapes, t.feed_version)
    first, last = date.fromisoformat(FIRST_DAY), date.fromisoformat(LAST_DAY)
    house.run_range(t.timetable, {**t.dims, "shape": shapes}, t.stop_updates, t.positions, first, last, days_per_job=15)
    return house.day()


# ---- feeds


@query
def valid_feed_snapshots(t: Lens) -> DataFrame:
    return flatten.valid_snapshots(t.trip_feed).groupBy("agency_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("length").alias("shortest")
    )


@query
def flatten_trip_updates(t: Lens) -> DataFrame:
    return flatten.flatten_trip_updates(flatten.valid_snapshots(t.trip_feed))


@query
def flatten_vehicle_positions(t: Lens) -> DataFrame:
    return flatten.flatten_vehicle_positions(flatten.valid_snapshots(t.vehicle_feed))


def _landed(t: Lens) -> str:
    """Folder with the vehicle snapshots as files, all landed on one day."""
    root = scratch_path(t.spark, "landed")
    for agency in range(5):
        body = t.vehicle_feed.filter(F.col("agency_key") == str(agency)).select("length", "header", "entity")
        body.write.json(f"{root}/{agency}/vehicle-positions/{LAST_DAY.replace('-', '/')}")
    return root


@query
def stream_snapshots_flatten(t: Lens) -> DataFrame:
    """Landed snapshot files, streamed and flattened."""
    out, state = (scratch_path(t.spark, name) for name in ("flat", "flat-state"))
    rows = streams.stream_vehicle_positions(t.spark, _landed(t))
    rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(out)


@query
def feed_day_staged(t: Lens) -> DataFrame:
    """Landed snapshot files through the feed-day run, as stored."""
    house = Warehouse(t.spark, scratch_path(t.spark, "house"))
    house.load_feed_day(_landed(t), date.fromisoformat(LAST_DAY), t.dims)
    return house.positions()


@query
def snapshots_compacted(t: Lens) -> DataFrame:
    """Many small snapshot files packed into one per agency, flattened."""
    out = scratch_path(t.spark, "packed")
    feeds.compact_day(t.spark, _landed(t), out, LAST_DAY)
    return flatten.flatten_vehicle_positions(flatten.valid_snapshots(feeds.read_feed(t.spark, out, feed="vehicle-positions", day=LAST_DAY)))


LANDINGS = ("2024-01-28", "2024-01-29", "2024-01-30")


@query
def feed_days_neighbouring(t: Lens) -> DataFrame:
    """The snapshots landed on three days in turn, each with pings of all service days, loaded one after the other with a cut-off at three."""
    root, house = scratch_path(t.spark, "landed"), Warehouse(t.spark, scratch_path(t.spark, "house"), Options(cutoff_hour=3))
    for turn, day in enumerate(LANDINGS):
        mine = t.vehicle_feed.filter(F.hour(F.timestamp_seconds("header.timestamp")) % 3 == turn)
        for agency in range(5):
            body = mine.filter(F.col("agency_key") == str(agency)).select("length", "header", "entity")
            body.write.json(f"{root}/{agency}/vehicle-positions/{day.replace('-', '/')}")
        house.load_feed_day(root, date.fromisoformat(day), t.dims)
    return house.positions()


@query
def timetable_day_staged(t: Lens) -> DataFrame:
    """Timetable files, with one row per trip and sequence so that the gate lets them pass, through the timetable-day run; the staged trips."""
    root = scratch_path(t.spark, "static")
    rest = [F.min(c).alias(c) for c in t.stop_times.columns if c not in ("trip_id", "stop_sequence")]
    visits = t.stop_times.groupBy("trip_id", "stop_sequence").agg(*rest).select(*t.stop_times.columns)
    for name, df in {**t.timetable, "stop_times": visits}.items():
        df.write.option("header", True).csv(f"{root}/{LAST_DAY.replace('-', '/')}/{name}.txt")
    house = Warehouse(t.spark, scratch_path(t.spark, "house"))
    house.load_timetable_day(root, date.fromisoformat(LAST_DAY))
    return house.staging()["trips"].select("trip_id", "route_id", "service_id", "direction_id")


@query
def stale_snapshots(t: Lens) -> DataFrame:
    aged = flatten.with_feed_age(t.vehicle_feed, "polled_at")
    return aged.groupBy("agency_key", "is_stale").agg(F.count(F.lit(1)).alias("n"), F.max("feed_age").alias("oldest"))


# ---- stored dimensions and the run ledger


def _two_days(t: Lens) -> Warehouse:
    """A warehouse after two timetable days: the first with every other stop only, the second with all of them, new names for some, and no
    transfers or calendar exceptions."""
    root, house = scratch_path(t.spark, "static"), Warehouse(t.spark, scratch_path(t.spark, "house"))
    # Both days land the same visits: they are grouped once.
    visits = t.stop_times.filter("stop_sequence rlike '^[0-9]+$'").groupBy("trip_id", "stop_sequence")
    visits = visits.agg(*[F.min(c).alias(c) for c in t.stop_times.columns if c not in ("trip_id", "stop_sequence")]).select(*t.stop_times.columns)
    grouped = scratch_path(t.spark, "visits")
    visits.write.parquet(grouped)
    visits = t.spark.read.schema(visits.schema).parquet(grouped)
    number = F.substring("stop_id", 2, 20).cast("bigint")
    first = t.stops.filter(number % 2 == 0)
    renamed = t.stops.withColumn("stop_name", F.when(number % 6 == 0, F.concat(F.lit("New "), "stop_name")).otherwise(F.col("stop_name")))
    days = {
        "2024-01-01": {**t.timetable, "stop_times": visits, "stops": first},
        "2024-01-15": {**t.timetable, "stop_times": visits, "stops": renamed, "transfers": None, "calendar_dates": None},
    }
    for day, tables in days.items():
        folder = f"{root}/{day.replace('-', '/')}"
        for name, df in tables.items():
            if df is not None:
                df.write.option("header", True).csv(f"{folder}/{name}.txt")
        info = t.spark.range(1).select(F.lit("Wayside Transit").alias("feed_publisher_name"), F.lit(day.replace("-", "")).alias("feed_start_date"),
                                       F.lit("20241231").alias("feed_end_date"), F.lit(f"v{day}").alias("feed_version"))
        info.write.option("header", True).csv(f"{folder}/feed_info.txt")
        at = F.lit(day).cast("date").cast("timestamp_ntz")
        feed = t.spark.range(1).select(F.sha2(F.lit(day), 256).alias("feedhash"), at.alias("ingestedat"))
        house.load_timetable_day(root, date.fromisoformat(day), feed, "main")
    return house


@query
def timetable_two_days(t: Lens) -> DataFrame:
    """The stops with the days their rows hold, and whether they keep the key of the first day."""
    stops = _two_days(t).dimensions.history("stop")
    keys_then = stops.filter("validfrom = date'2024-01-01'").select("stopid", F.col("stopkey").alias("before"))
    joined = stops.join(keys_then, "stopid", "left").withColumn("same_key", F.col("stopkey") == F.col("before"))
    return joined.select("stopid", "stopname", "versionkey", "validfrom", "validto", "same_key")


@query
def run_ledger_digest(t: Lens) -> DataFrame:
    """The digest of the days on which timetables were loaded, from the ledger and the stored versions."""
    house = _two_days(t)
    entries = house.ledger.entries()
    loaded = entries.select("run_date").distinct()
    none = t.spark.createDataFrame([], "run_date date, fallback_date date")
    digest = audit.daily_digest(ledger.runs(entries), house.validations(), none, ledger.versions_seen(entries), loaded)
    described = house.versions().select("feedhash", "feedstartdate", "feedpublishername", "filecount")
    return digest.join(described, digest["feed_hash"] == described["feedhash"]).select(
        "run_date", "run_status", "is_new_version", "file_count", "feed_hash", "headline", "feedstartdate", "feedpublishername"
    )


# ---- gaps


@query
def available_dates(t: Lens) -> DataFrame:
    found = gaps.available_dates(t.stop_updates, F.col("service_date"), AS_OF, 20).withColumn("source", F.lit("updates"))
    pings = gaps.available_dates(t.positions, clock.local_day("timestamp_local"), AS_OF, 20)
    return found.unionByName(pings.withColumn("source", F.lit("positions")))


@query
def gap_counters(t: Lens) -> DataFrame:
    return gaps.gap_counters(t.stored_stops, F.col("arrivalsource") == flags.FALLBACK)


@query
def feed_gaps_service_day(t: Lens) -> DataFrame:
    return gaps.missing_days(t.stored_trips, t.stored_days)


def _gaps(t: Lens) -> DataFrame:
    return gaps.gap_dates(t.stop_updates, t.positions, t.stored_stops, t.stored_trips, t.stored_days, AS_OF)


@query
def gap_dates(t: Lens) -> DataFrame:
    return _gaps(t)


@query
def gap_work_list(t: Lens) -> DataFrame:
    work = gaps.work_list(_gaps(t))
    return work.withColumn("gap_dates", F.array_join(F.transform("gap_dates", lambda d: d.cast("string")), ","))


# ---- versions and audit


def _documents_as_feeds(t: Lens) -> DataFrame:
    """Each document plays a published feed, ingested in the order of its id."""
    at = clock.utc_time(F.col("doc_id") + 1_700_000_000)
    return t.table("documents").select(
        audit.feed_hash("text").alias("feedhash"), at.alias("ingestedat"), F.col("source").alias("sourceurl"), "lang"
    )


def _registered(t: Lens) -> DataFrame:
    """Version table after the English documents."""
    empty = conform(t.table("region").limit(0), DIMENSIONS["feed_version"])
    english = _documents_as_feeds(t).filter("lang = 'en'").drop("lang")
    return audit.register_feed_version(empty, english)


@query
def feed_version_register(t: Lens) -> DataFrame:
    """Second registration: all documents; those known keep their keys."""
    result = audit.register_feed_version(_registered(t), _documents_as_feeds(t).drop("lang"))
    return result.select("versionkey", "feedhash", "ingestedat", "iscurrent", "isactive")


@query
def changed_feeds(t: Lens) -> DataFrame:
    fresh = audit.is_new_version(_documents_as_feeds(t).drop("lang"), _registered(t))
    return fresh.select("feedhash", "ingestedat")


@query
def current_feed_version(t: Lens) -> DataFrame:
    everything = audit.register_feed_version(_registered(t), _documents_as_feeds(t).drop("lang"))
    return keys.current_version(everything).select("versionkey")


@query
def latest_manifest(t: Lens) -> DataFrame:
    manifests = t.table("orders").select(
        F.col("o_orderpriority").alias("feed_key"), F.col("o_orderdate").cast("date").alias("load_date"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("feed_hash"),
        F.lit(True).alias("is_new_version"), (F.col("o_custkey") % 12).cast("int").alias("file_count"),
    )
    return audit.latest_manifest(manifests, "2000-01-01")


@query
def latest_audit_run(t: Lens) -> DataFrame:
    return latest.latest_run(_runs(t), "2024-01-15")


def _runs(t: Lens) -> DataFrame:
    failed = F.col("event_type") == "error"
    return t.table("events").select(
        F.col("ts").cast("date").alias("run_date"), F.col("ts").alias("run_timestamp"),
        F.when(failed, "FAILED").otherwise("SUCCEEDED").alias("status"),
        (F.col("event_type") == "signup").alias("is_new_version"), (F.col("user_id") % 12).cast("int").alias("file_count"),
        F.when(failed, F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("error"),
    )


@query
def daily_digest(t: Lens) -> DataFrame:
    events = t.table("events")
    day = F.col("ts").cast("date")
    validations = events.groupBy(day.alias("run_date")).agg(
        (F.count_if(F.col("value") > 100) == 0).alias("overall_passed"),
        F.count_if(F.col("event_type") == "view").cast("int").alias("passed"), F.count(F.lit(1)).cast("int").alias("total_tables"),
    )
    fallbacks = events.filter("event_type = 'error'").select(day.alias("run_date"), F.date_sub(day, 1).alias("fallback_date"))
    seen = events.select(day.alias("last_seen_date"), F.sha2(F.col("event_id").cast("string"), 256).alias("feedhash"))
    silent = t.spark.range(1).select(F.lit("2023-01-01").cast("date").alias("run_date"))
    return audit.daily_digest(_runs(t), validations, fallbacks, seen, events.select(day.alias("run_date")).unionByName(silent))


# ---- schema and validation


@query
def schema_reconcile(t: Lens) -> DataFrame:
    incoming = t.table("lineitem").select(
        F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").alias("stop_id"), F.col("l_linenumber").alias("stop_sequence"),
        F.col("l_returnflag").alias("ride_code"),
    )
    return reconcile(incoming, ["trip_id", "stop_id", "arrival_time", "departure_time", "stop_sequence"])


@query
def drifted_append(t: Lens) -> DataFrame:
    stored = t.table("supplier").select(F.col("s_name").alias("stop_name"), F.col("s_suppkey").cast("string").alias("stop_id"))
    incoming = t.table("part").select(F.col("p_partkey").cast("string").alias("stop_id"), F.col("p_brand").alias("zone_id"))
    return append_drifted(stored, incoming)


@query
def staging_drift_days(t: Lens) -> DataFrame:
    """Two stored days of which the first came with a column more, read together."""
    path, contract = scratch_path(t.spark, "drifting"), "stop_id string, stop_name string"
    first = t.table("supplier").select(F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_name"), F.col("s_nationkey").alias("zone_hint"))
    second = t.table("part").select(F.col("p_partkey").alias("stop_id"))
    for day, df in ((FIRST_DAY, first), (LAST_DAY, second)):
        evolve.write_evolved(df, path, date.fromisoformat(day), contract)
    return evolve.read_evolved(t.spark, path, contract)


@query
def null_profile(t: Lens) -> DataFrame:
    broken = t.stop_times.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("trip_id", "stop_id", "arrival_time", "departure_time")])
    return quality.null_profile(broken, broken.columns)


@query
def duplicate_profile(t: Lens) -> DataFrame:
    return quality.duplicate_profile(t.stop_times, ["trip_id", "stop_sequence"])


@query
def format_profile(t: Lens) -> DataFrame:
    return quality.format_profile(t.stop_times, "arrival_time")


@query
def format_samples(t: Lens) -> DataFrame:
    return quality.format_samples(t.stop_times, "stop_sequence", r"^[0-9]+$")


VALIDATED = ("agency", "routes", "stops", "trips", "stop_times", "calendar", "calendar_dates", "shapes", "transfers")


def _checks(t: Lens) -> DataFrame:
    frames = {name: t.timetable[name] for name in VALIDATED}
    return quality.check_tables(t.spark, {**frames, "fare_rules": None})


@query
def table_checks(t: Lens) -> DataFrame:
    return _checks(t)


@query
def table_verdicts(t: Lens) -> DataFrame:
    return quality.verdicts(_checks(t))


@query
def validation_summary(t: Lens) -> DataFrame:
    return quality.summary(quality.verdicts(_checks(t)))


@query
def validation_report_rows(t: Lens) -> DataFrame:
    """The report's rows per table, as read back from its files."""
    return sinks.write_report(_checks(t), scratch_path(t.spark, "report"))


@query
def referential_orphans(t: Lens) -> DataFrame:
    """References of the timetable lens with the stops and trips its dimensions lack taken out."""
    tables = dict(t.timetable)
    known = t.dims["stop"].select(F.col("stopid").alias("stop_id"))
    tables["stops"] = t.stops.join(known, "stop_id", "left_semi")
    tables["trips"] = t.trips.filter("trip_headsign <> '5-LOW'")
    return quality.reference_checks(tables)


@query
def preflight_counts(t: Lens) -> DataFrame:
    return quality.preflight_counts(t.dims, "trip", "stop", "route")


@query
def days_without_pings(t: Lens) -> DataFrame:
    service_dates = t.order_dates.unionByName(t.dates)
    return quality.days_without_pings(t.positions, service_dates)


# ---- dimensions


@query
def dim_date(t: Lens) -> DataFrame:
    holidays = t.table("orders").filter("o_totalprice > 450000").select(F.col("o_orderdate").cast("date").alias("holiday"))
    return dims.describe_dates(t.order_dates, holidays)


@query
def dim_time_usage(t: Lens) -> DataFrame:
    minutes = t.positions.select(clock.minute_of_day("timestamp_local").alias("timekey"))
    return minutes.join(dims.dim_time(t.spark), "timekey").groupBy("periodofday", "hour").agg(
        F.count(F.lit(1)).alias("pings"), F.max("minute").alias("last_minute"), F.min("timevalue").alias("first_time")
    )


def _dim_routes(t: Lens) -> DataFrame:
    return dims.dim_route(t.routes, t.dims["agency"], t.feed_version)


@query
def dim_agency(t: Lens) -> DataFrame:
    modes = t.table("region").select(
        F.col("r_regionkey").cast("string").alias("agency_id"),
        F.when(F.col("r_regionkey") % 2 == 0, "BUS").otherwise("RAIL").alias("mode"),
    )
    return dims.dim_agency(t.agency, modes).select("agencykey", "agencyid", "agencyname", "mode", "agencytimezone")


@query
def dim_route(t: Lens) -> DataFrame:
    return _dim_routes(t)


@query
def dim_stop(t: Lens) -> DataFrame:
    return dims.dim_stop(t.stops, t.feed_version)


@query
def dim_service(t: Lens) -> DataFrame:
    return dims.dim_service(t.calendar, t.calendar_dates, t.feed_version)


@query
def dim_shape(t: Lens) -> DataFrame:
    return dims.dim_shape(t.shapes, t.feed_version)


@query
def dim_direction(t: Lens) -> DataFrame:
    return dims.dim_direction(t.trips, t.dims["route"])


@query
def dim_calendar_exception(t: Lens) -> DataFrame:
    return dims.dim_calendar_exception(t.calendar_dates, t.feed_version)


@query
def dim_trip(t: Lens) -> DataFrame:
    """Trips keyed on top of a previous load that held every other trip."""
    services = dims.dim_service(t.calendar, t.calendar_dates, t.feed_version)
    directions = dims.dim_direction(t.trips, t.dims["route"])
    shapes = dims.dim_shape(t.shapes, t.feed_version)
    even = t.trips.filter(F.col("direction_id") == "0").select(F.col("trip_id").alias("tripid")).distinct()
    previous = keys.assign_keys(even, ["tripid"], "tripkey")
    return dims.dim_trip(t.trips, t.dims["route"], services, directions, shapes, t.feed_version, previous)


@query
def dim_stop_transfer(t: Lens) -> DataFrame:
    return dims.dim_stop_transfer(t.transfers, t.dims["stop"], t.feed_version)


@query
def scheduled_headways(t: Lens) -> DataFrame:
    windows = [(0, 359), (360, 899), (900, 1439)]
    services = calendar.active_services(t.calendar, t.calendar_dates, t.dates)
    return dims.dim_headway(t.stop_times, t.trips, t.dims["route"], services, windows)


@query
def dim_keys(t: Lens) -> DataFrame:
    """Stable keys over all parts: brands known before keep theirs."""
    parts = t.table("part").select("p_name", "p_brand").distinct()
    previous = keys.assign_keys(t.table("part").filter("p_size < 25").select("p_name", "p_brand").distinct(), ["p_name", "p_brand"], "partkey")
    return keys.extend_keys(parts, ["p_name", "p_brand"], "partkey", previous)


@query
def version_scoped_routes(t: Lens) -> DataFrame:
    """Only routes of the current feed version, where several versions coexist."""
    both = t.dims["route"].unionByName(t.dims["route"].withColumn("versionkey", F.lit(11)))
    rows = keys.current_rows(both, t.feed_version)
    return keys.resolve_route(t.trips, rows, t.dims["agency"]).groupBy("routekey", "agencykey").agg(F.count(F.lit(1)).alias("trips"))


# ---- alarms and streams


@query
def feed_failure_windows(t: Lens) -> DataFrame:
    return streams.failure_windows(t.poll_log)


@query
def outage_windows(t: Lens) -> DataFrame:
    """Outages as seen an hour after the last poll."""
    log = t.poll_log
    seen_at = log.agg(F.max("ts") + F.expr("interval 1 hour")).scalar()
    return streams.outage_windows(streams.poll_windows(log), as_of=seen_at)


def _event_stream(t: Lens) -> Lens:
    """The lens with events arriving as a file stream."""
    schema = t.table("events").schema
    reader = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return Lens(t.spark, t.folder, events=reader.parquet(t.folder))


def _run_stream(t: Lens, df: DataFrame, unique: list[str], newest: list[str], partition: str) -> DataFrame:
    path, checkpoint = scratch_path(t.spark, "stream-table"), scratch_path(t.spark, "stream-state")
    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    running = writer.foreachBatch(streams.upsert_latest(path, unique, newest, partition)).trigger(availableNow=True).start()
    running.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(path).select(*df.columns)


@query
def stream_ping_summary(t: Lens) -> DataFrame:
    summary = streams.stream_ping_summary(_event_stream(t).positions)
    return _run_stream(t, summary, ["trip_id", "service_date"], ["ping_count"], "service_date")


@query
def stream_positions_latest(t: Lens) -> DataFrame:
    rows = _event_stream(t).positions.select(
        "agency_key", "vehicle_id", "timestamp_utc", "feed_timestamp_utc", "trip_id", F.col("timestamp_utc").cast("date").alias("service_date")
    )
    return _run_stream(t, rows, ["agency_key", "vehicle_id", "timestamp_utc"], ["feed_timestamp_utc"], "service_date")


@query
def stream_positions_distinct(t: Lens) -> DataFrame:
    """Every ping delivered twice, in files of their own, and kept once."""
    landed, out, state = (scratch_path(t.spark, name) for name in ("twice", "once", "once-state"))
    for _ in range(2):
        t.table("events").write.mode("append").parquet(landed)
    events = t.spark.readStream.schema(t.table("events").schema).parquet(landed)
    keys_of = ["agency_key", "trip_id", "vehicle_id", "timestamp_utc", "latitude"]
    rows = streams.without_repeats(Lens(t.spark, t.folder, events=events).positions.select(*keys_of), keys_of, "timestamp_utc")
    rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(out)


def _landed_twice(t: Lens, name: str, by: str) -> DataFrame:
    """A table as a stream of files that landed in two turns, about one turn per batch; its rows are not moved for that."""
    rows, landed = t.table(name), scratch_path(t.spark, name)
    for turn in range(2):
        rows.filter(F.pmod(F.xxhash64(by), F.lit(2)) == turn).write.mode("append").parquet(landed)
    files = len(list_files(t.spark, f"{landed}/part-*"))
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(landed)


@query
def stream_trip_merge(t: Lens) -> DataFrame:
    """Scheduled trips with the pings of a stream merged in, batch by batch."""
    fact, parts, state = (scratch_path(t.spark, name) for name in ("fact-trip", "ping-parts", "merge-state"))
    sinks.replace_partition(trips.trip_skeleton(t.timetable, t.dims, t.dates), fact, "datekey")
    positions = Lens(t.spark, t.folder, events=_landed_twice(t, "events", "event_id")).positions
    facts.stream_trip_merge(positions, fact, parts, t.dims, state).awaitTermination()
    return sinks.read_table(t.spark, fact, FACT_TRIP).select(*PINGED)


@query
def stream_stop_merge(t: Lens) -> DataFrame:
    """Scheduled visits with the reports of a stream merged in, batch by batch."""
    fact, table, state = (scratch_path(t.spark, name) for name in ("fact-stop", "newest-updates", "merge-state"))
    buckets = sinks.buckets_for(t.table("lineitem"))
    stored = facts.stop_fact_by_visit(fact, buckets)
    stored.replace(stops.stop_skeleton(t.timetable, t.dims, t.dates, parts=buckets))
    used = [c for c in t.table("lineitem").columns if c not in ("l_extendedprice", "l_discount", "l_commitdate", "l_receiptdate", "l_comment")]
    lines = Lens(t.spark, t.folder, lineitem=t.table("lineitem").select(*used))
    updates = Lens(t.spark, t.folder, lineitem=_landed_twice(lines, "lineitem", "l_partkey")).stop_updates
    facts.stream_stop_merge(updates, fact, table, t.dims, state, buckets=buckets).awaitTermination()
    for laid in (stored, facts.updates_by_trip(table, buckets)):
        laid.forget(t.spark)
    return sinks.read_table(t.spark, fact, FACT_STOP).select(*[c for c in MERGED if c != "isofficial"])


@query
def stream_failure_windows(t: Lens) -> DataFrame:
    """Windows with failed polls from the stream, the last update of each."""
    events = _event_stream(t).table("events")
    failed = F.col("event_type") == "error"
    log = events.select(F.col("ts").cast("timestamp").alias("ts"), F.when(failed, 0).otherwise(1).alias("ok"), F.when(failed, 1).otherwise(0).alias("fail"))
    found = streams.stream_failure_windows(log).withColumn("day", F.col("window_start").cast("date"))
    stored = _run_stream(t, found, ["window_start"], ["fail", "ok"], "day")
    return stored.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "ok", "fail")


@query
def stream_outage_windows(t: Lens) -> DataFrame:
    """Outages raised live by timers, up to an hour after the last poll, when nothing but a heartbeat comes."""
    landed, out, state = (scratch_path(t.spark, name) for name in ("polls", "outages", "outages-state"))
    log = t.poll_log.select(F.lit("feed").alias("poller"), F.col("ts").cast("timestamp").alias("ts"), "ok", "fail")
    log.write.parquet(landed)
    last = t.poll_log.agg(F.max(F.col("ts").cast("timestamp_ntz"))).first()[0]
    alarms.heartbeat_at(t.spark, last + timedelta(hours=1, minutes=10)).write.mode("append").parquet(landed)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(store)
    t.spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        raised = alarms.live_outages(t.spark.readStream.schema(log.schema).parquet(landed), late="10 minutes")
        raised.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        t.spark.conf.set(store, before)
    return t.spark.read.schema(raised.schema).parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"))
