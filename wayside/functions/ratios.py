"""Exact ratios of counts, rounded half up with integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import ColumnOrName, as_column, int_div


def _scaled(part: ColumnOrName, whole: ColumnOrName, factor: int) -> Column:
    part = as_column(part).cast("bigint")
    whole = F.nullif(as_column(whole).cast("bigint"), F.lit(0).cast("bigint"))
    return int_div(part * (2 * factor) + whole, whole * 2)


def _shifted(scaled: Column, digits: int, precision: int) -> Column:
    """A whole number of the last digit's units as a decimal."""
    unit = F.lit(10**digits).cast(f"decimal({digits + 1},0)")
    return (scaled.cast("decimal(20,0)") / unit).cast(f"decimal({precision},{digits})")


def tenths(value: ColumnOrName) -> Column:
    """A whole number of tenths as a decimal with one digit."""
    return _shifted(as_column(value), 1, 6)


def pct(part: ColumnOrName, whole: ColumnOrName, digits: int = 1) -> Column:
    """``100 * part / whole`` rounded half up, as a decimal; NULL when ``whole`` is 0."""
    return _shifted(_scaled(part, whole, 100 * 10**digits), digits, 5 + digits)


def rate(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """``part / whole`` rounded half up, as decimal(5,4); NULL when ``whole`` is 0."""
    return _shifted(_scaled(part, whole, 10_000), 4, 5)


def zero_key(key: ColumnOrName) -> Column:
    """Surrogate key with 0 for unresolved."""
    return F.coalesce(as_column(key), F.lit(0))
