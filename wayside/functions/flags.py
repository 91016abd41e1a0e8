"""Performance flags of stops, trips and service days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import ColumnOrName, as_column, int_div
from .ratios import rate

# Thresholds and conversion constants.
EARLY_LIMIT_SECONDS = -60
LATE_LIMIT_SECONDS = 300
PING_INTERVAL_SECONDS = 30
METRES_PER_MILE = 1609.344

# Status words.
FALLBACK = "FALLBACK_SCHEDULED"
REPORTED = "GTFS_RT_REPORTED"
MISSED, OPERATED, CANCELLED, ADDED = "MISSED", "OPERATED", "CANCELLED", "ADDED"
RUN_STATUSES = (OPERATED, ADDED)
ADDED_FLAG = "ADDED_UNSCHEDULED"

# Feed enumerations.
SCHEDULE_RELATIONSHIP = {0: "SCHEDULED", 1: "ADDED", 2: "UNSCHEDULED", 3: "CANCELED"}
VEHICLE_STATUS = {0: "INCOMING_AT", 1: "STOPPED_AT", 2: "IN_TRANSIT_TO"}


def is_true(condition: Column) -> Column:
    """The condition with NULL read as false."""
    return F.coalesce(condition, F.lit(False))


def on_time(dev: ColumnOrName) -> Column:
    return is_true(as_column(dev).between(EARLY_LIMIT_SECONDS, LATE_LIMIT_SECONDS))


def early(dev: ColumnOrName) -> Column:
    return is_true(as_column(dev) < EARLY_LIMIT_SECONDS)


def late(dev: ColumnOrName) -> Column:
    return is_true(as_column(dev) > LATE_LIMIT_SECONDS)


def is_official_stop(ontime: ColumnOrName, missed: ColumnOrName, origin: ColumnOrName, terminal: ColumnOrName) -> Column:
    """Evaluated, served, and neither the first nor the last stop of its trip."""
    served = ~as_column(missed)
    inner = ~as_column(origin) & ~as_column(terminal)
    return is_true(as_column(ontime).isNotNull() & served & inner)


def has_run(status: ColumnOrName) -> Column:
    return as_column(status).isin(*RUN_STATUSES)


def is_official_trip(status, vrm, vrh, flag, estimated) -> Column:
    """Run with positive miles and hours, and no quality flag other than the harmless ones."""
    flag = as_column(flag)
    harmless = flag.isNull() | is_true(flag == ADDED_FLAG) | is_true(as_column(estimated))
    return is_true(has_run(status) & (as_column(vrm) > 0) & (as_column(vrh) > 0) & harmless)


def is_official_day(special, operated, alert) -> Column:
    return is_true(~as_column(special) & (as_column(operated) > 0) & ~as_column(alert))


def expected_pings(span: ColumnOrName) -> Column:
    """Pings expected over ``span`` seconds at one per interval, rounded down."""
    return int_div(span, PING_INTERVAL_SECONDS).cast("int")


def rt_coverage(pings: ColumnOrName, span: ColumnOrName) -> Column:
    """Share of expected pings seen, at most 1; NULL without a positive span.

    A span shorter than one interval expects no ping: the ratio is NULL, ``least`` skips it and
    the coverage is 1.
    """
    span = as_column(span)
    seen = rate(F.least(as_column(pings), expected_pings(span)), expected_pings(span))
    return F.when(span > 0, F.least(F.lit(1).cast("decimal(5,4)"), seen))


def hours_of(span: ColumnOrName, type_name: str = "decimal(10,4)") -> Column:
    """Seconds as hours, rounded to the fact column's scale."""
    return (as_column(span).cast("decimal(12,0)") / F.lit(3600).cast("decimal(4,0)")).cast(type_name)


def miles(metres: ColumnOrName, type_name: str = "decimal(12,4)") -> Column:
    """Metres as miles, rounded to the fact column's scale."""
    return (as_column(metres).cast("decimal(18,6)") / F.lit(str(METRES_PER_MILE)).cast("decimal(7,3)")).cast(type_name)


def decode(mapping: dict[int, str], code: ColumnOrName, default: str = "UNKNOWN") -> Column:
    """Enumeration label of an integer code."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_column(code)), F.lit(default))
