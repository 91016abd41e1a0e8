"""Column contracts of the staging, dimension and fact tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Columns of the staged timetable tables (all text).
STAGING_COLUMNS = {
    "agency": [
        "agency_id", "agency_name", "agency_url", "agency_timezone", "agency_lang", "agency_phone",
        "agency_fare_url", "agency_email",
    ],
    "calendar": [
        "service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date",
        "end_date",
    ],
    "calendar_dates": [
        "service_id", "date", "exception_type",
    ],
    "routes": [
        "agency_id", "route_id", "route_short_name", "route_long_name", "route_type", "route_desc", "route_url",
        "route_color", "route_text_color", "network_id", "route_sort_order",
    ],
    "shapes": [
        "shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence", "shape_dist_traveled",
    ],
    "stop_times": [
        "trip_id", "stop_id", "arrival_time", "departure_time", "timepoint", "stop_sequence", "stop_headsign",
        "pickup_type", "drop_off_type", "shape_dist_traveled", "departure_buffer",
    ],
    "stops": [
        "stop_id", "stop_name", "stop_lat", "stop_lon", "stop_code", "stop_desc", "zone_id", "stop_url",
        "location_type", "parent_station", "wheelchair_boarding", "stop_timezone", "platform_code", "tts_stop_name",
    ],
    "transfers": [
        "from_stop_id", "from_route_id", "to_stop_id", "to_route_id", "transfer_type", "min_transfer_time",
    ],
    "trips": [
        "route_id", "trip_id", "service_id", "trip_short_name", "trip_headsign", "direction_id", "block_id",
        "shape_id", "wheelchair_accessible", "drt_advance_book_min", "bikes_allowed", "fare_id", "peak_offpeak",
        "boarding_type",
    ],
}

# Staged real-time tables.
STOP_UPDATES = (
    "agency_key string, trip_id string, route_id string, direction_id int, schedule_relationship string,"
    " service_date date, stop_id string, stop_sequence int, arrival_delay int, arrival_time_utc bigint,"
    " arrival_time_local timestamp_ntz, departure_delay int, departure_time_utc bigint,"
    " departure_time_local timestamp_ntz, feed_timestamp_utc timestamp_ntz, arrival_source string"
)
VEHICLE_POSITIONS = (
    "agency_key string, trip_id string, route_id string, vehicle_id string, latitude double, longitude double,"
    " current_stop_sequence int, current_status string, timestamp_utc timestamp_ntz, timestamp_local timestamp_ntz,"
    " feed_timestamp_utc timestamp_ntz"
)

#: A decoded feed snapshot as stored in its file.
FEED_BODY = (
    "length int, header struct<timestamp: bigint>,"
    " entity array<struct<"
    "trip_update: struct<trip: struct<trip_id: string, route_id: string, direction_id: int,"
    " schedule_relationship: int>, stop_time_update: array<struct<stop_id: string, stop_sequence: int,"
    " arrival: struct<time: bigint, delay: int>, departure: struct<time: bigint, delay: int>>>>,"
    " vehicle: struct<trip: struct<trip_id: string, route_id: string>, vehicle: struct<id: string>,"
    " position: struct<latitude: double, longitude: double>, current_stop_sequence: int, current_status: int,"
    " timestamp: bigint>>>"
)
#: The same with agency and feed, which come from the file's path.
FEED_MESSAGE = "agency_key string, feed_type string, " + FEED_BODY

# Fact tables. Keys of trips, stops and other large sets are widened to bigint.
FACT_STOP = (
    "stopperformancekey bigint, tripkey bigint, routekey int, stopkey bigint, datekey int, timekey int, agencykey int,"
    " versionkey int, scheduledarrivalseconds int, scheduleddepartureseconds int, stopsequence int,"
    " actualarrival timestamp_ntz, actualdeparture timestamp_ntz, arrivaldevseconds int, arrivalsource string,"
    " interpolationconfidence decimal(3,2), isontime boolean, islate boolean, isearly boolean, isoriginstop boolean,"
    " isterminalstop boolean, ismissed boolean, isbunching boolean, isestimated boolean, isofficial boolean"
)
FACT_TRIP = (
    "tripkey bigint, datekey int, agencykey int, routekey int, versionkey int, tripstatus string,"
    " tripstatussource string, actualstarttime timestamp_ntz, actualendtime timestamp_ntz, tripendsource string,"
    " actualpingcount int, expectedpingcount int, rtcoveragerate decimal(5,4), scheduledvrm decimal(12,4),"
    " scheduledvrh decimal(10,4), reportedvrm decimal(12,4), reportedvrh decimal(10,4), isestimated boolean,"
    " isspecialevent boolean, isofficial boolean, dataqualityflag string"
)
FACT_SERVICE_DAY = (
    "agencykey int, datekey int, scheduledtrips int, operatedtrips int, missedtrips int, cancelledtrips int,"
    " missedtriprate decimal(5,4), unmatchedtripcount int, reportedvrm decimal(14,4), reportedvrh decimal(12,4),"
    " estimatedvrm decimal(14,4), estimatedvrh decimal(12,4), peakvehiclecount int, peaktimekey int,"
    " isspecialeventday boolean, feedgapflag boolean, dataqualityalertflag boolean, isofficial boolean"
)

# Dimension tables.
DIMENSIONS = {
    "agency": "agencykey int, agencyid string, agencyname string, mode string, agencytimezone string, gtfsrtfeedurl string",
    "calendar_exception": "calendarexceptionkey bigint, serviceid string, exceptiondate date, exceptiontype int, versionkey int",
    "date": "datekey int, fulldate date, dayofweek string, isweekend boolean, isholiday boolean, federalfiscalmonth int,"
    " calendarmonth int, calendaryear int",
    "direction": "directionkey int, directionid int, directionlabel string, routekey int",
    "feed_version": "versionkey int, feedhash string, sourceurl string, ingestedat timestamp_ntz, feedstartdate date,"
    " feedenddate date, feedpublishername string, feedversion string, filecount smallint, iscurrent boolean,"
    " isactive boolean, notes string",
    "headway": "headwaykey bigint, routekey int, timewindowstart int, timewindowend int, scheduledheadwayseconds int,"
    " headwaysource string",
    "route": "routekey int, agencykey int, routeid string, routeshortname string, routelongname string, routetype int,"
    " versionkey int",
    "service": "servicekey bigint, serviceid string, isspecialevent boolean, versionkey int",
    "shape": "shapekey bigint, shapeid string, totaldistancemeters decimal(10,2), versionkey int",
    "stop": "stopkey bigint, stopid string, stopname string, stoplat decimal(10,6), stoplon decimal(10,6), locationtype int,"
    " locationtypedesc string, parentstation string, versionkey int",
    "stop_transfer": "stoptransferkey bigint, fromstopkey bigint, tostopkey bigint, transfertype int, mintransfertimeseconds int,"
    " versionkey int",
    "time": "timekey int, timevalue timestamp_ntz, hour int, minute int, periodofday string",
    "trip": "tripkey bigint, routekey int, servicekey bigint, directionkey int, shapekey bigint, tripid string,"
    " tripheadsign string, versionkey int",
}


@lru_cache(maxsize=None)
def columns_of(ddl: str) -> tuple[tuple[str, str], ...]:
    """(name, type) pairs of a column list; needs a running session."""
    return tuple((field.name, field.dataType.simpleString()) for field in StructType.fromDDL(ddl).fields)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Exactly the contract's columns, in order and cast; absent ones become NULL."""
    present = set(df.columns)
    return df.selectExpr(
        *[f"cast({name if name in present else 'null'} as {type_}) as {name}" for name, type_ in columns_of(ddl)]
    )
