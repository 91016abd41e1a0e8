"""Data behind the dashboard visuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_ROUTES = 10


def month_of(date: str = "fulldate") -> Column:
    """First day of the month."""
    return F.trunc(F.col(date), "month")


def month_over_month(df: DataFrame, measure: str, date: str = "fulldate", by: Sequence[str] = ()) -> DataFrame:
    """Monthly sum of a measure and its percent difference from the month before it in the data.

    The window runs over monthly totals, one row per month and group.
    """
    months = df.groupBy(*by, month_of(date).alias("month")).agg(F.sum(measure).cast("double").alias("total"))
    previous = F.lag("total").over(Window.partitionBy(*by).orderBy("month"))
    months = months.withColumn("previous", previous)
    change = F.try_divide((F.col("total") - F.col("previous")) * 100, F.abs(F.col("previous")))
    return months.withColumn("pct_change", change)


def voms_by_month_and_agency(voms: DataFrame) -> DataFrame:
    """Line: monthly peak vehicles summed over the days of a month, per agency."""
    return voms.groupBy(month_of().alias("month"), "agencyname").agg(F.sum("monthly_voms").alias("monthly_voms")).orderBy("month", "agencyname")


def voms_by_mode(voms: DataFrame) -> DataFrame:
    """Bar: per mode and agency, largest first."""
    bars = voms.groupBy("mode", "agencyname").agg(F.sum("monthly_voms").alias("monthly_voms"))
    return bars.orderBy(F.desc("monthly_voms"), "mode", "agencyname")


def voms_by_period(voms: DataFrame) -> DataFrame:
    """Bar: per period of day, largest first."""
    bars = voms.groupBy("peak_period").agg(F.sum("monthly_voms").alias("monthly_voms"))
    return bars.orderBy(F.desc("monthly_voms"), "peak_period")


def voms_detail(voms: DataFrame) -> DataFrame:
    """Table: per month, agency, mode and period, newest first."""
    keys = ["agencyname", "mode", "peak_period"]
    rows = voms.groupBy(month_of().alias("month"), *keys).agg(
        F.sum("monthly_voms").alias("monthly_voms"), F.sum("ntd_period_voms").alias("ntd_period_voms")
    )
    return rows.orderBy(F.desc("month"), *keys)


def voms_report(voms: DataFrame) -> dict[str, DataFrame]:
    """The frames of the peak-vehicle dashboard."""
    return {
        "kpi_monthly": month_over_month(voms, "monthly_voms"),
        "kpi_ntd_period": month_over_month(voms, "ntd_period_voms"),
        "by_month": voms_by_month_and_agency(voms),
        "by_mode": voms_by_mode(voms),
        "by_period": voms_by_period(voms),
        "detail": voms_detail(voms),
    }


def for_agencies(alerts: DataFrame, agencies: Sequence[str] | None) -> DataFrame:
    """Rows of the listed agencies; rows without an agency name never match."""
    named = alerts.filter(F.col("agencyname").isNotNull())
    return named if agencies is None else named.filter(F.col("agencyname").isin(*agencies))


def coverage_kpi(alerts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Operated over scheduled trips: the ratio of the sums."""
    sums = alerts.groupBy(*by).agg(
        F.sum("operatedtrips").alias("operatedtrips"), F.sum("scheduledtrips").alias("scheduledtrips")
    )
    ratio = F.try_divide(F.col("operatedtrips").cast("double"), F.col("scheduledtrips").cast("double"))
    return sums.withColumn("rt_coverage_rate", ratio)


def alert_table(alerts: DataFrame) -> DataFrame:
    """Trips per day, agency and flags."""
    keys = ["fulldate", "agencyname", "dataqualityalertflag", "feedgapflag"]
    return alerts.groupBy(*keys).agg(
        F.sum("scheduledtrips").alias("scheduledtrips"), F.sum("operatedtrips").alias("operatedtrips")
    )


def alert_bars(alerts: DataFrame) -> DataFrame:
    """Operated and scheduled trips per day."""
    return alerts.groupBy("fulldate").agg(
        F.sum("operatedtrips").alias("operatedtrips"), F.sum("scheduledtrips").alias("scheduledtrips")
    ).orderBy("fulldate")


def alert_report(alerts: DataFrame, agencies: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The frames of the alert dashboard."""
    chosen = for_agencies(alerts, agencies)
    return {"coverage": coverage_kpi(chosen), "table": alert_table(chosen), "bars": alert_bars(chosen)}


def otp_trend(daily: DataFrame) -> DataFrame:
    """Line: daily percentage, newest first."""
    return daily.groupBy("fulldate").agg(F.sum("otp_pct").alias("otp_pct")).orderBy(F.desc("fulldate"))


def daily_volume(daily: DataFrame) -> DataFrame:
    """Bar: daily observations."""
    return daily.groupBy("fulldate").agg(F.sum("total_obs").alias("total_obs")).orderBy("fulldate")


def weekday_volume(daily: DataFrame) -> DataFrame:
    """Bar: observations by weekday, weekends marked."""
    bars = daily.groupBy("dayofweek", "isweekend").agg(F.sum("total_obs").alias("total_obs"))
    return bars.orderBy("dayofweek", "isweekend")


def otp_trend_report(daily: DataFrame) -> dict[str, DataFrame]:
    """The frames of the punctuality trend dashboard."""
    return {"trend": otp_trend(daily), "volume": daily_volume(daily), "weekdays": weekday_volume(daily)}


def top_routes(months: DataFrame, n: int = TOP_ROUTES) -> DataFrame:
    """The ``n`` routes with most observations."""
    totals = months.groupBy("routeshortname").agg(F.sum("total_obs").alias("total_obs"))
    return totals.orderBy(F.desc("total_obs"), "routeshortname").limit(n)


def top_route_otp(months: DataFrame, n: int = TOP_ROUTES) -> DataFrame:
    """Summed percentage of those routes, best first."""
    kept = months.join(top_routes(months, n).select("routeshortname"), "routeshortname", "left_semi")
    bars = kept.groupBy("routeshortname").agg(F.sum("otp_pct").alias("otp_pct"))
    return bars.orderBy(F.desc("otp_pct"), "routeshortname")
