"""Shared session and a small hand-written timetable."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from wayside.operators.dims import describe_dates, dim_time  # noqa: E402
from wayside.operators.calendar import date_range  # noqa: E402
from wayside.schemas import DIMENSIONS, STAGING_COLUMNS, STOP_UPDATES, VEHICLE_POSITIONS, conform  # noqa: E402
from wayside.session import build_session  # noqa: E402
from wayside.sources.static import reconcile  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def frame(spark, ddl: str, *rows):
    return spark.createDataFrame(list(rows), ddl)


def staged(spark, table: str, names: str, *rows):
    """A staging table from rows of the named columns."""
    ddl = ", ".join(f"{c} string" for c in names.split())
    return reconcile(spark.createDataFrame(list(rows), ddl), STAGING_COLUMNS[table])


def rows(df, *columns):
    """Rows as a sorted list of tuples, for comparison."""
    chosen = df.select(*columns) if columns else df
    return sorted([tuple(r) for r in chosen.collect()], key=lambda r: tuple((v is not None, str(v)) for v in r))


class Town:
    """Two routes, four services, Monday 2024-01-01 to Sunday 2024-01-07."""

    def __init__(self, spark):
        self.spark = spark
        week = "1 1 1 1 1 0 0".split()
        self.stg = {
            "agency": staged(spark, "agency", "agency_id agency_name agency_url agency_timezone",
                             ("1", "North", "u", "z"), ("40", "South", "u", "z")),
            "routes": staged(spark, "routes", "route_id agency_id route_short_name route_type",
                             ("r1", "1", "One", "3"), ("r2", "40", "Two", "0")),
            "stops": staged(spark, "stops", "stop_id stop_name stop_lat stop_lon",
                            *[(f"s{i}", f"Stop {i}", "47.1", "-122.3") for i in range(1, 5)]),
            "trips": staged(spark, "trips", "trip_id route_id service_id shape_id direction_id",
                            ("t1", "r1", "week", "h1", "0"), ("t2", "r1", "week", "h1", "1"), ("t3", "r2", "gala", "h2", "0"),
                            ("t4", "r2", "extra", None, "0"), ("t5", "r9", "week", "h9", "0")),
            "stop_times": staged(spark, "stop_times", "trip_id stop_id arrival_time departure_time stop_sequence",
                                 ("t1", "s1", "08:00:00", "08:00:30", "1"), ("t1", "s2", "08:10:00", "08:10:30", "2"),
                                 ("t1", "s3", "08:20:00", "08:20:30", "3"), ("t1", "s4", "08:30:00", "08:30:00", "A1"),
                                 ("t1", "s4", "", "08:31:00", "4"),
                                 ("t2", "s3", "23:50:00", "23:50:00", "1"), ("t2", "s2", "24:30:00", "24:30:00", "2"),
                                 ("t2", "s9", "25:00:00", "25:00:00", "3"), ("t2", "s1", "25:15:00", "25:15:00", "4"),
                                 ("t3", "s1", "10:00:00", "10:00:00", "1"), ("t3", "s2", "09:00:00", "09:00:00", "2"),
                                 ("t4", "s1", "12:00:00", "12:00:00", "5"), ("t4", "s3", "12:40:00", "12:45:00", "9"),
                                 ("t9", "s1", "12:00:00", "12:00:00", "1")),
            "calendar": staged(spark, "calendar", "service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date",
                               ("week", *week, "20240101", "20240105"), ("extra", *"0 0 0 0 0 0 0".split(), "20240101", "20241231"),
                               ("broken", *"1 1 1 1 1 1 1".split(), "soon", "20241231")),
            "calendar_dates": staged(spark, "calendar_dates", "service_id date exception_type",
                                     ("gala", "20240106", "1"), ("extra", "20240106", "1"), ("week", "20240103", "2"),
                                     ("both", "20240104", "1"), ("both", "20240104", "2"), ("week", "20240107", "1")),
            "shapes": staged(spark, "shapes", "shape_id shape_pt_lat shape_pt_lon shape_pt_sequence shape_dist_traveled",
                             ("h1", "1", "1", "1", "0"), ("h1", "1", "1", "2", "16093.44"), ("h1", "1", "1", "3", "n/a"),
                             ("h2", "1", "1", "1", ""), ("h2", "1", "1", "2", "x")),
            "transfers": staged(spark, "transfers", "from_stop_id to_stop_id transfer_type", ("s1", "s2", "0")),
        }
        self.dates = date_range(spark, "2024-01-01", "2024-01-07")
        dim = lambda name, ddl, *r: conform(spark.createDataFrame(list(r), ddl), DIMENSIONS[name])
        self.dims = {
            "agency": dim("agency", "agencykey int, agencyid string, agencyname string, mode string",
                          (1, "1", "North", "BUS"), (2, "40", "South", "RAIL")),
            "route": dim("route", "routekey int, agencykey int, routeid string, routeshortname string, versionkey int",
                         (11, 1, "r1", "One", 1), (12, 2, "r2", "Two", 1)),
            "stop": dim("stop", "stopkey bigint, stopid string", *[(20 + i, f"s{i}") for i in range(1, 5)]),
            "trip": dim("trip", "tripkey bigint, tripid string", *[(30 + i, f"t{i}") for i in range(1, 6)], (0, "t9")),
            "shape": dim("shape", "shapekey bigint, shapeid string", (1, "h1")),
            "time": dim_time(spark),
            "date": describe_dates(self.dates),
            "feed_version": dim("feed_version", "versionkey int, ingestedat timestamp_ntz, iscurrent boolean", *self.versions()),
        }

    @staticmethod
    def versions():
        from datetime import datetime
        return [(1, datetime(2023, 1, 1), False), (7, datetime(2024, 1, 1), True), (8, datetime(2023, 6, 1), True)]

    def updates(self, *entries):
        """Stop updates from (trip, stop, sequence, date, arrival, feed time[, agency])."""
        ddl = ("trip_id string, stop_id string, stop_sequence int, service_date date, arrival_time_local timestamp_ntz,"
               " feed_timestamp_utc timestamp_ntz, agency_key string")
        full = [(*e, "a") if len(e) == 6 else e for e in entries]
        return conform(self.spark.createDataFrame(full, ddl), STOP_UPDATES)

    def pings(self, *entries):
        """Vehicle positions from (trip, local time[, agency])."""
        ddl = "trip_id string, timestamp_local timestamp_ntz, agency_key string"
        full = [(*e, "1") if len(e) == 2 else e for e in entries]
        return conform(self.spark.createDataFrame(full, ddl), VEHICLE_POSITIONS)


@pytest.fixture(scope="session")
def town(spark):
    return Town(spark)
