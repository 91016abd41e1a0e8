"""Served copies of the views, refreshed only where the facts have changed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import date_key
from ..schemas import FACT_SERVICE_DAY, FACT_STOP, FACT_TRIP
from ..sources.sinks import overwrite_table, read_table, replace_days
from ..sources.static import list_files, path_exists
from . import views

FACTS = {"stop": FACT_STOP, "trip": FACT_TRIP, "day": FACT_SERVICE_DAY}
STATE = "datekey int, files string"


@dataclass(frozen=True)
class Served:
    """A view over one fact whose rows depend on the days of one period only: ``period`` names it in the view's rows, and
    ``months`` tells whether it is a month or a single day."""

    fact: str
    build: Callable[[DataFrame, Mapping[str, DataFrame]], DataFrame]
    period: Column | str
    months: bool = False


def _month(month: str) -> str:
    return f"calendaryear * 100 + {month}"


#: Views by name. Those over a moving window of days (late routes, daily summary) are small and refreshed whole.
SERVED = {
    "otp_by_route_month": Served("stop", views.otp_by_route_month, _month("calendarmonth"), True),
    "missed_rate_by_route": Served("trip", views.missed_rate_by_route, "fulldate"),
    "voms": Served("day", views.voms, _month("calendarmonth"), True),
    "daily_hours": Served("day", views.daily_hours, "fulldate"),
    "daily_miles": Served("day", views.daily_miles, "fulldate"),
    "quality_daily": Served("stop", views.quality_daily, "fulldate"),
    "quality_alerts": Served("day", views.quality_alerts, "fulldate"),
    "missed_trend": Served("day", views.missed_trend, "fulldate"),
    # A fiscal month is a calendar month under another number, kept within the calendar year.
    "monthly_ntd": Served("day", views.monthly_ntd, _month("(federalfiscalmonth + 8) % 12 + 1"), True),
}


def files_of_days(spark: SparkSession, path: str) -> dict[int, str]:
    """A digest of the file names of each date partition of a fact, from one listing; no file is opened."""
    days: dict[int, list[str]] = {}
    for file in list_files(spark, f"{path}/datekey=*/*"):
        day, _, name = file.rsplit("datekey=", 1)[1].partition("/")
        days.setdefault(int(day), []).append(name)
    return {day: hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest() for day, names in days.items()}


def changed_days(before: Mapping[int, str], now: Mapping[int, str]) -> list[int]:
    """Days whose files are not those of the last refresh; also those that have gone."""
    return sorted(day for day in {*before, *now} if before.get(day) != now.get(day))


def within(fact: DataFrame, periods: list[int], months: bool) -> DataFrame:
    """Fact rows of the periods; partitions of other days are not opened."""
    if not months:
        return fact.filter(F.col("datekey").isin(periods))
    spans = [F.col("datekey").between(100 * month + 1, 100 * month + 31) for month in periods]
    inside = spans[0]
    for span in spans[1:]:
        inside = inside | span
    return fact.filter(inside)


def refresh_changed(spark: SparkSession, paths: Mapping[str, str], dims: Mapping[str, DataFrame], out: str,
                    names: list[str] | None = None) -> dict[str, list[int]]:
    """Bring the served views up to the facts stored at ``paths``; returns the periods recomputed per view.

    A fact partition counts as changed if its files are not those seen by the last refresh. A view recomputes the
    periods that hold changed days, from the fact's partitions of these periods alone, and replaces them; a period that came out
    empty is removed. What was seen is noted last, so a refresh that fails is made up for by the next. A view named for the first time is
    built whole.
    """
    done: dict[str, list[int]] = {}
    for fact, path in paths.items():
        mine = [n for n, s in SERVED.items() if s.fact == fact and (names is None or n in names)]
        now = files_of_days(spark, path)
        for name in mine:
            seen = read_table(spark, f"{out}/_seen/{name}", STATE).collect()
            days = changed_days({r["datekey"]: r["files"] for r in seen}, now)
            view = SERVED[name]
            periods = done[name] = sorted({d // 100 for d in days}) if view.months else days
            if not periods:
                continue
            rows = view.build(within(read_table(spark, path, FACTS[fact]), periods, view.months), dims)
            period = F.expr(view.period) if view.months else date_key(view.period)
            wanted = spark.createDataFrame([(p,) for p in periods], "period int")
            rows = rows.withColumn("period", period.cast("int"))
            overwrite_table(rows.limit(0), f"{out}/_columns/{name}")  # a view without rows has columns, too
            replace_days(rows, f"{out}/{name}", "period", wanted)
            overwrite_table(spark.createDataFrame(sorted(now.items()), STATE).coalesce(1), f"{out}/_seen/{name}")
    return done


def served(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The served copy of a view."""
    columns = spark.read.parquet(f"{out}/_columns/{name}").schema
    found = spark.read.schema(columns).parquet(f"{out}/{name}") if path_exists(spark, f"{out}/{name}") else spark.createDataFrame([], columns)
    return found.drop("period")
