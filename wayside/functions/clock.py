"""Schedule times, service dates and wall-clock arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400
DAY_MINUTES = 1_440
DEFAULT_ZONE = "America/Los_Angeles"

ColumnOrName = Column | str


def as_column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def int_div(left: ColumnOrName, right) -> Column:
    """Integer division (truncating), which ``/`` is not."""
    right = right if isinstance(right, Column) else F.lit(right)
    return F.call_function("div", as_column(left), right)


def _time_part(text: Column, position: int) -> Column:
    return F.split_part(text, F.lit(":"), F.lit(position)).try_cast("bigint")


def gtfs_seconds(text: ColumnOrName) -> Column:
    """``HH:MM:SS`` to seconds after midnight; hours above 23 are kept, malformed text is NULL."""
    text = as_column(text)
    total = _time_part(text, 1) * 3600 + _time_part(text, 2) * 60 + _time_part(text, 3)
    return total.try_cast("int")


def gtfs_minute_key(text: ColumnOrName) -> Column:
    """Minute of day 0-1439 of a schedule time, wrapping past midnight."""
    text = as_column(text)
    return ((_time_part(text, 1) * 60 + _time_part(text, 2)) % DAY_MINUTES).try_cast("int")


def minute_of_day(ts: ColumnOrName) -> Column:
    ts = as_column(ts)
    return F.hour(ts) * 60 + F.minute(ts)


def date_key(date: ColumnOrName) -> Column:
    """yyyymmdd integer of a date."""
    date = as_column(date)
    return F.year(date) * 10_000 + F.month(date) * 100 + F.dayofmonth(date)


def month_of_key(key: ColumnOrName) -> Column:
    """yyyymm of a yyyymmdd integer."""
    return F.call_function("div", as_column(key), F.lit(100)).cast("int")


def date_from_key(key: ColumnOrName) -> Column:
    """Date of a yyyymmdd integer; NULL where the key names no calendar day."""
    return F.try_to_date(F.lpad(as_column(key).cast("string"), 8, "0"), "yyyyMMdd")


def gtfs_date(text: ColumnOrName) -> Column:
    """Date of yyyymmdd text; NULL where it does not parse."""
    return F.try_to_date(as_column(text), "yyyyMMdd")


def key_days_before(as_of, days: int = 0) -> Column:
    """Date key of the day ``days`` before ``as_of``: a constant to compare date keys with.

    Comparing keys instead of dates lets a table partitioned by date key skip partitions.
    """
    return date_key(F.date_sub(F.lit(as_of).cast("date"), days))


def local_day(ts: ColumnOrName) -> Column:
    """Calendar day of a wall-clock timestamp."""
    return as_column(ts).cast("date")


def epoch_second(ts: ColumnOrName) -> Column:
    """Whole seconds since 1970 of a wall-clock timestamp, fractions dropped.

    Built from calendar fields, so it never passes through the session time zone.
    """
    ts = as_column(ts)
    days = F.unix_date(ts.cast("date")).cast("bigint")
    return days * DAY_SECONDS + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def elapsed_seconds(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Second boundaries crossed from ``start`` to ``end``."""
    return epoch_second(end) - epoch_second(start)


def scheduled_instant(service_date: ColumnOrName, seconds: ColumnOrName) -> Column:
    """Wall-clock instant of a schedule time counted from its service date."""
    offset = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), as_column(seconds))
    return as_column(service_date).cast("timestamp_ntz") + offset


def deviation_seconds(service_date: ColumnOrName, seconds: ColumnOrName, actual: ColumnOrName) -> Column:
    """Actual minus scheduled arrival in seconds; positive is late."""
    midnight = F.unix_date(as_column(service_date)).cast("bigint") * DAY_SECONDS
    return (epoch_second(actual) - midnight - as_column(seconds)).cast("int")


def utc_time(epoch: ColumnOrName) -> Column:
    """Epoch seconds as a UTC wall-clock timestamp."""
    offset = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), as_column(epoch))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + offset


def local_time(epoch: ColumnOrName, zone: str = DEFAULT_ZONE) -> Column:
    """Epoch seconds as wall-clock time in ``zone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_time(epoch))


def service_day(ts: ColumnOrName, cutoff_hour: int = 0) -> Column:
    """Service day of a wall-clock time; before ``cutoff_hour`` it belongs to the day before."""
    ts = as_column(ts)
    if cutoff_hour:
        ts = ts - F.make_dt_interval(F.lit(0), F.lit(cutoff_hour))
    return ts.cast("date")


def since(date: ColumnOrName, as_of, days: int) -> Column:
    """True for dates in the ``days`` before ``as_of`` and later."""
    return as_column(date) >= F.date_sub(F.lit(as_of).cast("date"), days)


def default_day(as_of) -> Column:
    """The day processed when none is named: the one before ``as_of``."""
    return F.date_sub(F.lit(as_of).cast("date"), 1)
