"""Which days still need work, per fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flags
from ..functions.clock import date_from_key, date_key, key_days_before, local_day, since

# Fixed value: days scanned back.
LOOKBACK_DAYS = 30
STOP_JOB, TRIP_JOB, DAY_JOB = "stop-fact", "trip-fact", "service-day-fact"


def available_dates(source: DataFrame, day, as_of, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Distinct days a staging table holds within the look-back window."""
    days = source.select(day.alias("service_date")).filter(since("service_date", as_of, lookback))
    return days.distinct()


def gap_counters(fact: DataFrame, open_row) -> DataFrame:
    """Per date key: rows still open, and all rows."""
    return fact.groupBy("datekey").agg(
        F.count_if(open_row).alias("open_count"), F.count(F.lit(1)).alias("total_count")
    )


def recent_rows(fact: DataFrame, as_of, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """Fact rows of the look-back window; a constant bound on the partition column."""
    return fact.filter(F.col("datekey") >= key_days_before(as_of, lookback))


def fact_gaps(dates: DataFrame, fact: DataFrame, open_row) -> DataFrame:
    """Days without rows (``missing``) or with open rows (``merge``) among ``dates``."""
    keyed = dates.select("service_date", date_key("service_date").alias("datekey"))
    counted = keyed.join(gap_counters(fact, open_row), "datekey", "left")
    state = F.when(F.col("total_count").isNull(), "missing").when(F.col("open_count") > 0, "merge")
    return counted.select("service_date", state.alias("state")).filter("state is not null")


def missing_days(fact_trip: DataFrame, fact_day: DataFrame) -> DataFrame:
    """Days with operated trips of an agency that lacks its service-day row."""
    operated = fact_trip.filter(F.col("tripstatus") == flags.OPERATED).select("agencykey", "datekey").distinct()
    lacking = operated.join(fact_day.select("agencykey", "datekey"), ["agencykey", "datekey"], "left_anti")
    return lacking.select(date_from_key("datekey").alias("service_date")).distinct()


def gap_dates(
    stop_updates: DataFrame,
    positions: DataFrame,
    fact_stop: DataFrame,
    fact_trip: DataFrame,
    fact_day: DataFrame,
    as_of,
    lookback: int = LOOKBACK_DAYS,
) -> DataFrame:
    """(job, service_date, state) of every day that needs work.

    Service days are due for the days the trip job will touch, and for older days with operated
    trips but no service-day row.
    """
    fact_stop, fact_trip, fact_day = (recent_rows(fact, as_of, lookback) for fact in (fact_stop, fact_trip, fact_day))
    stop_dates = available_dates(stop_updates, F.col("service_date"), as_of, lookback)
    recent = positions.filter(since("timestamp_local", as_of, lookback))
    ping_dates = available_dates(recent, local_day("timestamp_local"), as_of, lookback)
    stop_gaps = fact_gaps(stop_dates, fact_stop, F.col("arrivalsource") == flags.FALLBACK)
    trip_gaps = fact_gaps(ping_dates, fact_trip, F.col("tripstatus") == flags.MISSED)
    settled = ping_dates.join(trip_gaps, "service_date", "left_anti")
    history = missing_days(fact_trip, fact_day).join(settled, "service_date", "left_semi")
    day_gaps = history.union(trip_gaps.select("service_date")).distinct().withColumn("state", F.lit("missing"))
    return (
        stop_gaps.select(F.lit(STOP_JOB).alias("job"), "service_date", "state")
        .union(trip_gaps.select(F.lit(TRIP_JOB), "service_date", "state"))
        .union(day_gaps.select(F.lit(DAY_JOB), "service_date", "state"))
    )


def work_list(gaps: DataFrame) -> DataFrame:
    """One row per job: phase, first and last day, and the list of days (bounded by the look-back).

    A job with any missing day runs both phases, one with open rows only merges, one with neither
    is skipped; the service-day job has the single phase ``load``.
    """
    jobs = gaps.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(j) for j in (STOP_JOB, TRIP_JOB, DAY_JOB)])).alias("job")
    )
    per_job = gaps.groupBy("job").agg(
        F.bool_or(F.col("state") == "missing").alias("_missing"),
        F.min("service_date").alias("start_date"),
        F.max("service_date").alias("end_date"),
        F.sort_array(F.collect_set("service_date")).alias("gap_dates"),
    )
    skip = F.col("start_date").isNull()
    phase = F.when(skip, "none").when(F.col("job") == DAY_JOB, "load").when(F.col("_missing"), "both").otherwise("merge")
    return jobs.join(per_job, "job", "left").select("job", skip.alias("skip"), phase.alias("phase"), "start_date", "end_date", "gap_dates")


def job_dates(work: DataFrame, job: str) -> DataFrame:
    """The days of one job as a ``service_date`` frame, ready for the fact operators."""
    return work.filter(F.col("job") == job).select(F.explode("gap_dates").alias("service_date"))
