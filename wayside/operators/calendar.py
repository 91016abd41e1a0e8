"""Which services run on which dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import gtfs_date
from ..functions.flags import is_true

# Weekly calendar columns, Monday first, and exception codes.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
ADDED_CODE, REMOVED_CODE = "1", "2"


def date_range(spark: SparkSession, start, end) -> DataFrame:
    """Inclusive list of service dates; the operators take any frame with that column."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(days).alias("service_date"))


def runs_on(date: Column) -> Column:
    """True where the weekly calendar row marks the weekday of ``date``."""
    flags = F.array(*[F.col(day) for day in WEEKDAYS])
    return is_true(F.element_at(flags, F.weekday(date) + 1) == "1")


def weekly_days(calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """(service_id, service_date) of the weekly calendar.

    Each calendar row unfolds into its own validity days, clipped to the span of ``dates``, so no
    calendar row ever meets a date it is not valid on.
    """
    first = dates.agg(F.min("service_date")).scalar()
    last = dates.agg(F.max("service_date")).scalar()
    start, end = gtfs_date("start_date"), gtfs_date("end_date")
    dated = calendar.filter(start.isNotNull() & end.isNotNull())
    valid = dated.select(
        "service_id", *WEEKDAYS, F.greatest(start, first).alias("_from"), F.least(end, last).alias("_to")
    ).filter(F.col("_from") <= F.col("_to"))
    days = valid.withColumn("service_date", F.explode(F.sequence("_from", "_to"))).filter(runs_on(F.col("service_date")))
    return days.join(dates.distinct(), "service_date", "left_semi").select("service_id", "service_date")


def exception_days(calendar_dates: DataFrame, dates: DataFrame, code: str) -> DataFrame:
    """(service_id, service_date) of one exception type."""
    rows = calendar_dates.filter(F.col("exception_type") == code)
    rows = rows.select("service_id", gtfs_date("date").alias("service_date"))
    return rows.join(dates.distinct(), "service_date", "left_semi").select("service_id", "service_date")


def service_days(calendar: DataFrame, calendar_dates: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per (service, date) with what the timetable says about it.

    ``active``     in (weekly calendar union added) except removed
    ``cancelled``  removed that day, whether or not it would have run
    ``special``    added that day and absent from the weekly calendar altogether

    The three set expressions become one aggregation, which combines before its shuffle.
    """
    def tagged(df: DataFrame, tag: str) -> DataFrame:
        return df.select("service_id", "service_date", *[F.lit(t == tag).alias(t) for t in ("weekly", "added", "removed")])

    marks = (
        tagged(weekly_days(calendar, dates), "weekly")
        .union(tagged(exception_days(calendar_dates, dates, ADDED_CODE), "added"))
        .union(tagged(exception_days(calendar_dates, dates, REMOVED_CODE), "removed"))
        .groupBy("service_id", "service_date")
        .agg(*[F.bool_or(t).alias(t) for t in ("weekly", "added", "removed")])
    )
    known = calendar.select("service_id").distinct().withColumn("_known", F.lit(True))
    return marks.join(known, "service_id", "left").select(
        "service_id",
        "service_date",
        ((F.col("weekly") | F.col("added")) & ~F.col("removed")).alias("active"),
        F.col("removed").alias("cancelled"),
        (F.col("added") & F.col("_known").isNull()).alias("special"),
    )


def active_services(calendar: DataFrame, calendar_dates: DataFrame, dates: DataFrame) -> DataFrame:
    """Services running per date: (weekly union added) except removed, by set operations."""
    planned = weekly_days(calendar, dates).union(exception_days(calendar_dates, dates, ADDED_CODE))
    return planned.subtract(exception_days(calendar_dates, dates, REMOVED_CODE))


def cancelled_services(calendar_dates: DataFrame, dates: DataFrame) -> DataFrame:
    return exception_days(calendar_dates, dates, REMOVED_CODE).distinct()


def special_services(calendar: DataFrame, calendar_dates: DataFrame, dates: DataFrame) -> DataFrame:
    """Services added on a date that have no weekly calendar row at all."""
    return exception_days(calendar_dates, dates, ADDED_CODE).join(calendar, "service_id", "left_anti").distinct()


def scheduled_services(active: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Services whose trips appear in the trip fact: active or cancelled."""
    return active.union(cancelled).distinct()
