"""Reporting views over the facts.

Facts are aggregated by their keys before dimension attributes are attached wherever the view
groups, so the star joins run on the small result. Dimensions carry no broadcast hint: Spark
broadcasts those below its size threshold.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flags
from ..functions.clock import int_div, key_days_before
from ..functions.ratios import pct, tenths

Dims = Mapping[str, DataFrame]

AGENCY = ("agencyname", "mode")
ROUTE = ("routeid", "routeshortname", "routelongname")

# Bounds of the late-route report.
LATE_WINDOW_DAYS = 30
LATE_DAY_PCT = 70
LATE_MIN_DAYS = 5


def with_agency(df: DataFrame, dims: Dims) -> DataFrame:
    return df.join(dims["agency"].select("agencykey", *AGENCY), "agencykey")


def with_route(df: DataFrame, dims: Dims) -> DataFrame:
    return df.join(dims["route"].select("routekey", *ROUTE), "routekey")


def with_date(df: DataFrame, dims: Dims, *columns: str) -> DataFrame:
    return df.join(dims["date"].select("datekey", *columns), "datekey")


def star(fact: DataFrame, dims: Dims, *date_columns: str) -> DataFrame:
    """Fact rows with agency and date attributes; rows without either are dropped."""
    return with_date(with_agency(fact, dims), dims, *date_columns)


def daily_otp_summary(stops: DataFrame, dims: Dims, as_of=None, start=None) -> DataFrame:
    """Observations, trips, routes and official share per day, from ``start`` to ``as_of`` where given.

    Rows first collapse to one per (day, trip, route); the two distinct counts run on those.
    """
    span = stops if start is None else stops.filter(F.col("datekey") >= key_days_before(start))
    span = span if as_of is None else span.filter(F.col("datekey") <= key_days_before(as_of))
    per_trip = span.groupBy("datekey", "tripkey", "routekey").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("isofficial").alias("_official")
    )
    days = with_date(per_trip, dims, "fulldate", "dayofweek", "isweekend").groupBy("fulldate", "dayofweek", "isweekend").agg(
        F.sum("_n").alias("total_obs"),
        F.countDistinct("tripkey").alias("unique_trips"),
        F.countDistinct("routekey").alias("unique_routes"),
        F.sum("_official").alias("_official"),
    )
    return days.withColumn("otp_pct", pct("_official", "total_obs", 1)).drop("_official")


def otp_by_route_month(stops: DataFrame, dims: Dims) -> DataFrame:
    """Official observations per route and month with the on-time share.

    The month comes from the date key, so the large aggregation needs no join; the date dimension
    then confirms each day and names its month.
    """
    per_day = stops.filter("isofficial").groupBy("agencykey", "routekey", "datekey").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("isontime").alias("_ontime"),
        F.count_if("islate").alias("_late"),
        F.count_if("isearly").alias("_early"),
    )
    keys = ["agencykey", "routekey", "calendaryear", "calendarmonth"]
    months = with_date(per_day, dims, "calendaryear", "calendarmonth").groupBy(*keys).agg(
        F.sum("_n").alias("total_obs"),
        F.sum("_ontime").alias("ontime"),
        F.sum("_late").alias("late"),
        F.sum("_early").alias("early"),
    )
    named = with_route(with_agency(months, dims), dims)
    return named.select(
        "agencykey", *AGENCY, "routekey", *ROUTE, "calendaryear", "calendarmonth", "total_obs", "ontime", "late", "early",
        pct("ontime", "total_obs", 1).alias("otp_pct"),
    )


def missed_rate_by_route(trips: DataFrame, dims: Dims) -> DataFrame:
    """Trip counts by status and missed share of all rows per route and day."""
    status = F.col("tripstatus")
    days = trips.groupBy("agencykey", "routekey", "datekey").agg(
        F.count(F.lit(1)).alias("total_scheduled_trips"),
        F.count_if(status == flags.OPERATED).alias("operated_trips"),
        F.count_if(status == flags.MISSED).alias("missed_trips"),
        F.count_if(status == flags.CANCELLED).alias("cancelled_trips"),
    )
    named = with_route(star(days, dims, "fulldate", "calendarmonth", "calendaryear"), dims)
    return named.select(
        "agencykey", *AGENCY, "routekey", *ROUTE, "fulldate", "calendarmonth", "calendaryear",
        "total_scheduled_trips", "operated_trips", "missed_trips", "cancelled_trips",
        pct("missed_trips", "total_scheduled_trips", 2).alias("missed_trip_rate_pct"),
    )


def routes_consistently_late(stops: DataFrame, dims: Dims, as_of, window_days: int = LATE_WINDOW_DAYS) -> DataFrame:
    """Routes below 70 % on time on at least five days of the window before ``as_of`` (None: of all days), worst first.

    Daily percentages are averaged as whole numbers of tenths, so the rounding is exact.
    """
    recent = stops.filter("isofficial")
    if as_of is not None:
        recent = recent.filter(F.col("datekey") >= key_days_before(as_of, window_days))
    per_day = recent.groupBy("agencykey", "routekey", "datekey").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("isontime").alias("_ontime")
    )
    days = with_date(per_day, dims, "fulldate")
    days = days.withColumn("_tenths", (pct("_ontime", "_n", 1) * 10).cast("bigint"))
    routes = days.groupBy("agencykey", "routekey").agg(
        F.count(F.lit(1)).alias("days_evaluated"),
        F.count_if(F.col("_tenths") < LATE_DAY_PCT * 10).alias("days_below_70pct"),
        F.sum("_tenths").alias("_sum"),
        tenths(F.min("_tenths")).alias("worst_day_otp_pct"),
        tenths(F.max("_tenths")).alias("best_day_otp_pct"),
    )
    late = with_route(with_agency(routes.filter(F.col("days_below_70pct") >= LATE_MIN_DAYS), dims), dims)
    average = int_div(F.col("_sum") * 2 + F.col("days_evaluated"), F.col("days_evaluated") * 2)
    return late.select(
        "agencykey", *AGENCY, "routekey", *ROUTE, "days_evaluated", "days_below_70pct",
        tenths(average).alias("avg_otp_pct"), "worst_day_otp_pct", "best_day_otp_pct",
    ).orderBy(F.desc("days_below_70pct"), "avg_otp_pct", "routekey")


def voms(days: DataFrame, dims: Dims) -> DataFrame:
    """Daily peak vehicles with the peaks of the calendar month and of the fiscal month.

    Fiscal months are grouped within the *calendar* year, as published. Partitions of the window
    hold at most the 31 days of a month of one agency.
    """
    regular = days.filter(~F.col("isspecialeventday") & (F.col("operatedtrips") > 0))
    named = star(regular, dims, "fulldate", "calendarmonth", "calendaryear", "federalfiscalmonth")
    periods = dims["time"].select(
        F.col("timekey").alias("peaktimekey"), F.col("timevalue").alias("peak_time"), F.col("periodofday").alias("peak_period")
    )
    peak = F.max("peakvehiclecount")
    month = Window.partitionBy("agencykey", "mode", "calendaryear", "calendarmonth")
    fiscal = Window.partitionBy("agencykey", "mode", "calendaryear", "federalfiscalmonth")
    return named.join(periods, "peaktimekey", "left").select(
        "datekey", "fulldate", "calendarmonth", "calendaryear", "federalfiscalmonth", "agencykey", *AGENCY,
        "peakvehiclecount", "peaktimekey", "peak_time", "peak_period",
        peak.over(month).alias("monthly_voms"), peak.over(fiscal).alias("ntd_period_voms"),
    )


def _daily_quantity(days: DataFrame, dims: Dims, unit: str) -> DataFrame:
    reported, estimated = F.col(f"reported{unit}"), F.col(f"estimated{unit}")
    total = F.coalesce(reported, F.lit(0)) + F.coalesce(estimated, F.lit(0))
    regular = days.filter(~F.col("isspecialeventday"))
    return star(regular, dims, "fulldate", "calendaryear", "calendarmonth", "federalfiscalmonth").select(
        "agencykey", *AGENCY, "fulldate", "calendaryear", "calendarmonth", "federalfiscalmonth", reported, estimated,
        total.alias(f"total_{unit}_including_estimated"), "isofficial",
    )


def daily_hours(days: DataFrame, dims: Dims) -> DataFrame:
    """Revenue hours per agency and day; the total adds the estimated part, as published."""
    return _daily_quantity(days, dims, "vrh")


def daily_miles(days: DataFrame, dims: Dims) -> DataFrame:
    """Revenue miles per agency and day; the total adds the estimated part, as published."""
    return _daily_quantity(days, dims, "vrm")


def quality_daily(stops: DataFrame, dims: Dims) -> DataFrame:
    """Stop rows per day: all, official, and without a resolved trip."""
    days = stops.groupBy("datekey").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("isofficial").alias("official"),
        F.count_if(F.col("tripkey") == 0).alias("unmatched_trip"),
    )
    return with_date(days, dims, "fulldate").select("fulldate", "total", "official", "unmatched_trip")


def quality_alerts(days: DataFrame, dims: Dims) -> DataFrame:
    """Service days with a quality alert or a feed gap."""
    flagged = days.filter(F.col("dataqualityalertflag") | F.col("feedgapflag"))
    return star(flagged, dims, "fulldate").select(
        "fulldate", *AGENCY, "scheduledtrips", "operatedtrips", "dataqualityalertflag", "feedgapflag", "isofficial"
    )


def missed_trend(days: DataFrame, dims: Dims) -> DataFrame:
    """Missed trips per agency and day."""
    return star(days, dims, "fulldate").select("fulldate", *AGENCY, "scheduledtrips", "missedtrips", "missedtriprate")


def monthly_ntd(days: DataFrame, dims: Dims) -> DataFrame:
    """Official miles, hours and trips per agency and fiscal month."""
    official = star(days.filter("isofficial"), dims, "calendaryear", "federalfiscalmonth")
    return official.groupBy(*AGENCY, "calendaryear", "federalfiscalmonth").agg(
        F.sum("reportedvrm").alias("total_vrm"),
        F.sum("reportedvrh").alias("total_vrh"),
        F.sum("scheduledtrips").alias("total_scheduled"),
        F.sum("operatedtrips").alias("total_operated"),
        F.sum("missedtrips").alias("total_missed"),
    )


def create_views(facts: Mapping[str, DataFrame], dims: Dims, as_of, start=None) -> dict[str, DataFrame]:
    """Every view by name; ``start`` is the first day of the daily summary."""
    stop, trip, day = facts["stop"], facts["trip"], facts["day"]
    return {
        "daily_otp_summary": daily_otp_summary(stop, dims, as_of, start),
        "otp_by_route_month": otp_by_route_month(stop, dims),
        "missed_rate_by_route": missed_rate_by_route(trip, dims),
        "routes_consistently_late": routes_consistently_late(stop, dims, as_of),
        "voms": voms(day, dims),
        "daily_hours": daily_hours(day, dims),
        "daily_miles": daily_miles(day, dims),
        "quality_daily": quality_daily(stop, dims),
        "quality_alerts": quality_alerts(day, dims),
        "missed_trend": missed_trend(day, dims),
        "monthly_ntd": monthly_ntd(day, dims),
    }


def register_views(facts: Mapping[str, DataFrame], dims: Dims, as_of, start=None) -> list[str]:
    """Expose the views to SQL as temporary views; returns their names."""
    views = create_views(facts, dims, as_of, start)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
