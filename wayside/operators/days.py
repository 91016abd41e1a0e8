"""Service-day fact: counts, miles and hours, peak vehicles."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flags
from ..functions.clock import DAY_MINUTES, minute_of_day
from ..functions.ratios import rate
from ..schemas import FACT_SERVICE_DAY, conform

# Shares of operated trips that raise the flags.
FEED_GAP_SHARE = Decimal("0.20")
ESTIMATED_SHARE = Decimal("0.15")

DAY_KEYS = ["agencykey", "datekey"]


def trip_intervals(fact_trip: DataFrame, overnight: str = "wrap") -> DataFrame:
    """Minute intervals during which each operated, regular trip is out, one row per interval.

    ``overnight='wrap'`` splits a trip whose clock time passes midnight into the evening and the
    morning part. ``overnight='clock'`` follows the source rule: only a start *timestamp* after
    the end counts as overnight and covers every minute after the start or before the end, and
    other trips whose end minute precedes their start minute cover nothing.
    """
    return fact_trip.withColumn("_span", F.explode(_spans(overnight))).select(*DAY_KEYS, "_span.first_minute", "_span.last_minute")


def _spans(overnight: str) -> Column:
    """The minute intervals of a trip; NULL or none where it does not count."""
    running = (
        (F.col("tripstatus") == flags.OPERATED)
        & ~F.col("isspecialevent")
        & F.col("actualstarttime").isNotNull()
        & F.col("actualendtime").isNotNull()
    )
    def span(first, last):
        return F.struct(first.alias("first_minute"), last.alias("last_minute"))

    start, end = minute_of_day("actualstarttime"), minute_of_day("actualendtime")
    zero, midnight = F.lit(0), F.lit(DAY_MINUTES - 1)
    plain = F.array(span(start, end))
    split = F.array(span(start, midnight), span(zero, end))
    if overnight == "wrap":
        return F.when(running & (start <= end), plain).when(running, split)
    turned = F.col("actualstarttime") > F.col("actualendtime")
    pieces = F.when(running & turned & (start <= end), F.array(span(zero, midnight)))
    return pieces.when(running & turned, split).when(running & (start <= end), plain)


def active_levels(fact_trip: DataFrame, overnight: str = "wrap") -> DataFrame:
    """Number of active trips as steps: constant from ``first_minute`` to ``last_minute``.

    Each interval contributes +1 at its first minute and -1 after its last, instead of one row per
    minute. The changes combine before the shuffle, and a day has at most 1441 of them, so the
    running total per agency and day is a window of bounded size whatever the number of trips.
    """
    spans = trip_intervals(fact_trip, overnight)
    change = F.explode(
        F.array(
            F.struct(F.col("first_minute").alias("minute"), F.lit(1).alias("step")),
            F.struct((F.col("last_minute") + 1).alias("minute"), F.lit(-1).alias("step")),
        )
    )
    changes = spans.withColumn("_c", change).groupBy(*DAY_KEYS, F.col("_c.minute").alias("minute"))
    changes = changes.agg(F.sum("_c.step").alias("step"))
    order = Window.partitionBy(*DAY_KEYS).orderBy("minute")
    return changes.select(
        *DAY_KEYS,
        F.col("minute").alias("first_minute"),
        (F.lead("minute").over(order) - 1).alias("last_minute"),
        F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("active_trips"),
    ).filter("last_minute is not null and active_trips > 0")


def active_per_minute(fact_trip: DataFrame, overnight: str = "wrap") -> DataFrame:
    """Active trips for every minute with at least one."""
    levels = active_levels(fact_trip, overnight)
    minutes = F.explode(F.sequence("first_minute", "last_minute")).alias("timekey")
    return levels.select(*DAY_KEYS, minutes, "active_trips")


def peak_vehicles(fact_trip: DataFrame, overnight: str = "wrap") -> DataFrame:
    """Peak concurrent trips per agency and day and the latest minute at which it is reached."""
    best = F.max(F.struct("active_trips", "last_minute"))
    peaks = active_levels(fact_trip, overnight).groupBy(*DAY_KEYS).agg(best.alias("_best"))
    return peaks.select(
        *DAY_KEYS, F.col("_best.active_trips").alias("peakvehiclecount"), F.col("_best.last_minute").alias("peaktimekey")
    )


def service_day(fact_trip: DataFrame, overnight: str = "wrap") -> DataFrame:
    """One row per agency and day: counts, rates, miles, hours, peak and quality flags.

    The fact is read once: a trip adds its figures at minute -1 and its steps at the minutes it starts and stops. All of it
    combines to at most 1442 rows per agency and day before the shuffle; these give the running total, its peak and the sums.
    """
    status = F.col("tripstatus")
    ran = flags.has_run(status)
    estimated = ran & flags.is_true(F.col("isestimated"))
    own = F.col("_c.minute") == -1

    def count(condition):
        return F.count_if(own & condition)

    def total(condition, column: str):
        return F.sum(F.when(own & condition, F.col(column)).otherwise(0))

    figures = {
        "scheduledtrips": count(F.lit(True)),
        "operatedtrips": count(ran),
        "missedtrips": count(status == flags.MISSED),
        "cancelledtrips": count(status == flags.CANCELLED),
        "unmatchedtripcount": count(F.col("tripkey") == 0),
        "reportedvrm": total(ran, "reportedvrm"),
        "reportedvrh": total(ran, "reportedvrh"),
        "estimatedvrm": total(estimated, "reportedvrm"),
        "estimatedvrh": total(estimated, "reportedvrh"),
        "_silent": count(ran & F.col("actualpingcount").isNull()),
        "_estimated": count(estimated),
        "_special": count(flags.is_true(F.col("isspecialevent"))),
    }
    def at(minute, step):
        return F.struct(minute.cast("int").alias("minute"), F.lit(step).alias("step"))

    steps = F.flatten(F.transform(_spans(overnight), lambda s: F.array(at(s["first_minute"], 1), at(s["last_minute"] + 1, -1))))
    points = F.concat(F.array(at(F.lit(-1), 0)), F.coalesce(steps, F.array().cast("array<struct<minute: int, step: int>>")))
    spread = fact_trip.withColumn("_c", F.explode(points))
    minutes = spread.groupBy(*DAY_KEYS, F.col("_c.minute").alias("minute")).agg(
        F.sum("_c.step").alias("step"), *[column.alias(name) for name, column in figures.items()]
    )
    order = Window.partitionBy(*DAY_KEYS).orderBy("minute")
    active = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    levels = minutes.withColumns({"_active": active, "_until": F.lead("minute").over(order) - 1})
    level = F.struct(F.col("_active").alias("active_trips"), F.col("_until").alias("last_minute"))
    days = levels.groupBy(*DAY_KEYS).agg(
        F.max(F.when((F.col("_active") > 0) & F.col("_until").isNotNull(), level)).alias("_best"), *[F.sum(n).alias(n) for n in figures]
    )
    operated = F.col("operatedtrips")
    alert = F.col("_estimated") > F.lit(ESTIMATED_SHARE) * operated
    special = F.col("_special") > 0
    return conform(
        days.withColumns(
            {
                "peakvehiclecount": F.coalesce("_best.active_trips", F.lit(0)),
                "peaktimekey": F.coalesce("_best.last_minute", F.lit(0)),
                "isspecialeventday": special,
                "missedtriprate": rate("missedtrips", F.col("scheduledtrips") - F.col("cancelledtrips")),
                "feedgapflag": F.col("_silent") > F.lit(FEED_GAP_SHARE) * operated,
                "dataqualityalertflag": alert,
                "isofficial": flags.is_official_day(special, "operatedtrips", alert),
            }
        ),
        FACT_SERVICE_DAY,
    )


def day_profile(fact_day: DataFrame) -> DataFrame:
    """The day fact rounded for reading, in key order."""
    return fact_day.select(
        *DAY_KEYS,
        "scheduledtrips",
        "operatedtrips",
        "missedtrips",
        "cancelledtrips",
        F.round("missedtriprate", 3).alias("missedtriprate"),
        F.round("reportedvrm", 2).alias("reportedvrm"),
        F.round("reportedvrh", 2).alias("reportedvrh"),
        "peakvehiclecount",
        "isspecialeventday",
        "feedgapflag",
        "dataqualityalertflag",
        "isofficial",
    ).orderBy(*reversed(DAY_KEYS))
