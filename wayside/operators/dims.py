"""Dimension builders from staged timetable tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import DAY_SECONDS, date_key, gtfs_date, gtfs_seconds
from ..functions.guards import non_blank, numeric_or_null
from ..functions.ratios import zero_key
from ..schemas import DIMENSIONS, conform
from .calendar import date_range
from .keys import extend_keys, resolve_key, version_key

#: (first minute, last minute, label) of the day's periods; boundaries are ours to choose.
DAY_PERIODS = ((360, 539, "AM Peak"), (900, 1139, "PM Peak"))
BASE_PERIOD = "Base"

# Location type codes of the timetable format.
LOCATION_TYPES = {0: "Stop", 1: "Station", 2: "Entrance/Exit", 3: "Generic Node", 4: "Boarding Area"}


def describe_dates(dates: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Date dimension rows for a ``service_date`` frame. Federal fiscal months start in October."""
    day = F.col("service_date")
    rows = dates.select("service_date").distinct()
    if holidays is not None:
        marked = holidays.select(F.col("holiday").alias("service_date")).distinct().withColumn("_holiday", F.lit(True))
        rows = rows.join(marked, "service_date", "left")
    else:
        rows = rows.withColumn("_holiday", F.lit(False))
    return conform(
        rows.select(
            date_key(day).alias("datekey"),
            day.alias("fulldate"),
            F.date_format(day, "EEEE").alias("dayofweek"),
            (F.weekday(day) >= 5).alias("isweekend"),
            F.coalesce("_holiday", F.lit(False)).alias("isholiday"),
            ((F.month(day) + 2) % 12 + 1).alias("federalfiscalmonth"),
            F.month(day).alias("calendarmonth"),
            F.year(day).alias("calendaryear"),
        ),
        DIMENSIONS["date"],
    )


def dim_date(spark: SparkSession, start, end, holidays: DataFrame | None = None) -> DataFrame:
    return describe_dates(date_range(spark, start, end), holidays)


def period_of(minute, periods: Sequence[tuple[int, int, str]] = DAY_PERIODS):
    label = F.lit(BASE_PERIOD)
    for first, last, name in periods:
        label = F.when(minute.between(first, last), name).otherwise(label)
    return label


def dim_time(spark: SparkSession, periods: Sequence[tuple[int, int, str]] = DAY_PERIODS) -> DataFrame:
    """The 1440 minutes of a day."""
    minute = F.col("id").cast("int")
    midnight = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return conform(
        spark.range(0, 1440, 1, 1).select(
            minute.alias("timekey"),
            (midnight + F.make_dt_interval(F.lit(0), F.lit(0), minute)).alias("timevalue"),
            F.floor(minute / 60).alias("hour"),
            (minute % 60).alias("minute"),
            period_of(minute, periods).alias("periodofday"),
        ),
        DIMENSIONS["time"],
    )


def _keyed(rows: DataFrame, natural: Sequence[str], key: str, previous: DataFrame | None, name: str) -> DataFrame:
    """One row per natural key (smallest attributes win), keyed and conformed."""
    rest = [c for c in rows.columns if c not in natural]
    named = rows.filter(" and ".join(f"{c} is not null" for c in natural))
    one = named.distinct()
    if rest:
        best = named.groupBy(*natural).agg(F.min(F.struct(*rest)).alias("_row"))
        one = best.select(*natural, *[F.col(f"_row.{c}").alias(c) for c in rest])
    return conform(extend_keys(one, natural, key, previous), DIMENSIONS[name])


def dim_agency(agency: DataFrame, modes: DataFrame | None = None, previous: DataFrame | None = None) -> DataFrame:
    """``modes`` optionally gives (agency_id, mode); the timetable has no mode per agency."""
    rows = agency.select(
        F.col("agency_id").alias("agencyid"),
        F.col("agency_name").alias("agencyname"),
        F.col("agency_timezone").alias("agencytimezone"),
    )
    if modes is not None:
        rows = rows.join(modes.select(F.col("agency_id").alias("agencyid"), "mode"), "agencyid", "left")
    return _keyed(rows, ["agencyid"], "agencykey", previous, "agency")


def dim_route(routes: DataFrame, agencies: DataFrame, versions: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    keyed = resolve_key(routes, agencies, "agency_id", "agencyid", "agencykey")
    rows = keyed.select(
        F.col("route_id").alias("routeid"),
        "agencykey",
        F.col("route_short_name").alias("routeshortname"),
        F.col("route_long_name").alias("routelongname"),
        F.col("route_type").try_cast("int").alias("routetype"),
        version_key(versions).alias("versionkey"),
    )
    return _keyed(rows, ["routeid"], "routekey", previous, "route")


def dim_stop(stops: DataFrame, versions: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    kind = F.coalesce(F.col("location_type").try_cast("int"), F.lit(0))
    pairs = [F.lit(x) for item in LOCATION_TYPES.items() for x in item]
    rows = stops.select(
        F.col("stop_id").alias("stopid"),
        F.col("stop_name").alias("stopname"),
        F.col("stop_lat").try_cast("decimal(10,6)").alias("stoplat"),
        F.col("stop_lon").try_cast("decimal(10,6)").alias("stoplon"),
        kind.alias("locationtype"),
        F.try_element_at(F.create_map(*pairs), kind).alias("locationtypedesc"),
        F.col("parent_station").alias("parentstation"),
        version_key(versions).alias("versionkey"),
    )
    return _keyed(rows, ["stopid"], "stopkey", previous, "stop")


def dim_service(
    calendar: DataFrame, calendar_dates: DataFrame, versions: DataFrame, previous: DataFrame | None = None
) -> DataFrame:
    """Services of either table; special events are those without a weekly calendar row."""
    both = calendar.select("service_id", F.lit(False).alias("isspecialevent")).union(
        calendar_dates.select("service_id", F.lit(True))
    )
    rows = both.select(F.col("service_id").alias("serviceid"), "isspecialevent", version_key(versions).alias("versionkey"))
    return _keyed(rows, ["serviceid"], "servicekey", previous, "service")


def dim_shape(shapes: DataFrame, versions: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    lengths = shapes.groupBy("shape_id").agg(F.max(numeric_or_null("shape_dist_traveled")).alias("totaldistancemeters"))
    rows = lengths.select(
        F.col("shape_id").alias("shapeid"), "totaldistancemeters", version_key(versions).alias("versionkey")
    )
    return _keyed(rows, ["shapeid"], "shapekey", previous, "shape")


def dim_direction(trips: DataFrame, routes: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Directions each route runs in."""
    keyed = resolve_key(trips, routes, "route_id", "routeid", "routekey")
    code = F.col("direction_id").try_cast("int")
    rows = keyed.select("routekey", code.alias("directionid")).filter("directionid is not null")
    rows = rows.withColumn("directionlabel", F.when(F.col("directionid") == 0, "Outbound").otherwise("Inbound"))
    return _keyed(rows, ["routekey", "directionid"], "directionkey", previous, "direction")


def dim_calendar_exception(calendar_dates: DataFrame, versions: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    rows = calendar_dates.select(
        F.col("service_id").alias("serviceid"),
        gtfs_date("date").alias("exceptiondate"),
        F.col("exception_type").try_cast("int").alias("exceptiontype"),
        version_key(versions).alias("versionkey"),
    )
    return _keyed(rows, ["serviceid", "exceptiondate", "exceptiontype"], "calendarexceptionkey", previous, "calendar_exception")


def dim_trip(
    trips: DataFrame,
    routes: DataFrame,
    services: DataFrame,
    directions: DataFrame,
    shapes: DataFrame,
    versions: DataFrame,
    previous: DataFrame | None = None,
) -> DataFrame:
    keyed = resolve_key(trips, routes, "route_id", "routeid", "routekey")
    keyed = resolve_key(keyed, services, "service_id", "serviceid", "servicekey")
    keyed = resolve_key(keyed, shapes, "shape_id", "shapeid", "shapekey")
    keyed = keyed.withColumn("_direction", F.col("direction_id").try_cast("int"))
    sides = directions.select("directionkey", F.col("directionid").alias("_direction"), "routekey")
    rows = keyed.join(sides, ["routekey", "_direction"], "left").select(
        F.col("trip_id").alias("tripid"),
        "routekey",
        "servicekey",
        zero_key("directionkey").alias("directionkey"),
        "shapekey",
        F.col("trip_headsign").alias("tripheadsign"),
        version_key(versions).alias("versionkey"),
    )
    return _keyed(rows, ["tripid"], "tripkey", previous, "trip")


def dim_stop_transfer(transfers: DataFrame, stops: DataFrame, versions: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Transfers with both ends resolved to stop keys."""
    origin = stops.select(F.col("stopid").alias("from_stop_id"), F.col("stopkey").alias("fromstopkey"))
    target = stops.select(F.col("stopid").alias("to_stop_id"), F.col("stopkey").alias("tostopkey"))
    joined = transfers.join(origin, "from_stop_id", "left").join(target, "to_stop_id", "left")
    rows = joined.select(
        zero_key("fromstopkey").alias("fromstopkey"),
        zero_key("tostopkey").alias("tostopkey"),
        F.coalesce(F.col("transfer_type").try_cast("int"), F.lit(0)).alias("transfertype"),
        F.col("min_transfer_time").try_cast("int").alias("mintransfertimeseconds"),
        version_key(versions).alias("versionkey"),
    )
    return _keyed(rows, ["fromstopkey", "tostopkey", "transfertype"], "stoptransferkey", previous, "stop_transfer")


def dim_headway(
    stop_times: DataFrame, trips: DataFrame, routes: DataFrame, services: DataFrame, windows: Sequence[tuple[int, int]],
    previous: DataFrame | None = None,
) -> DataFrame:
    """Scheduled headway of each route in minute windows of the day: mean gap between departures of one service day.

    ``services`` (service_id, service_date) holds the active services of the days to average over. A departure past
    midnight counts by its time on the clock. The gaps of n departures add up to the distance of the first and the last,
    so two extremes and a count per service replace an ordered pass; services unfold into their days only after that.
    """
    starts = stop_times.filter(non_blank("departure_time")).groupBy("trip_id")
    starts = starts.agg((F.min(gtfs_seconds("departure_time")) % DAY_SECONDS).alias("departs"))
    known = trips.select("trip_id", "route_id", "service_id")
    placed = resolve_key(starts.join(known, "trip_id"), routes, "route_id", "routeid", "routekey")
    bounds = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in windows])
    minute = F.floor(F.col("departs") / 60)
    placed = placed.withColumn("_w", F.explode(F.filter(bounds, lambda w: minute.between(w["a"], w["b"]))))
    place = ["routekey", F.col("_w.a").alias("timewindowstart"), F.col("_w.b").alias("timewindowend")]
    per_service = placed.groupBy(*place, "service_id").agg(
        F.min("departs").alias("_first"), F.max("departs").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    key = ["routekey", "timewindowstart", "timewindowend"]
    per_day = per_service.join(services.select("service_id", "service_date"), "service_id").groupBy(*key, "service_date").agg(
        (F.max("_last") - F.min("_first")).alias("_span"), (F.sum("_n") - 1).alias("_gaps")
    )
    total = per_day.groupBy(*key).agg(F.sum("_span").alias("_span"), F.sum("_gaps").alias("_gaps")).filter("_gaps > 0")
    gap = F.call_function("div", F.col("_span"), F.col("_gaps")).cast("int")
    rows = total.select(*key, gap.alias("scheduledheadwayseconds"), F.lit("TIMETABLE").alias("headwaysource"))
    return _keyed(rows, key, "headwaykey", previous, "headway")
