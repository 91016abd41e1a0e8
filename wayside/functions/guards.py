"""Predicates over untyped text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import ColumnOrName, as_column

# Text patterns accepted in timetable files.
INTEGER_PATTERN = r"^[0-9]+$"
DECIMAL_PATTERN = r"^[0-9]+([.][0-9]+)?$"
TIME_PATTERN = r"^\d{1,2}:\d{2}:\d{2}$"


def is_int(text: ColumnOrName) -> Column:
    return as_column(text).rlike(INTEGER_PATTERN)


def is_decimal(text: ColumnOrName) -> Column:
    return as_column(text).rlike(DECIMAL_PATTERN)


def is_gtfs_time(text: ColumnOrName) -> Column:
    return as_column(text).rlike(TIME_PATTERN)


def non_blank(text: ColumnOrName) -> Column:
    """Neither NULL nor empty."""
    text = as_column(text)
    return text.isNotNull() & (text != "")


def blank_to_null(text: ColumnOrName) -> Column:
    text = as_column(text)
    return F.nullif(F.trim(text), F.lit(""))


def numeric_or_null(text: ColumnOrName, type_name: str = "decimal(18,6)") -> Column:
    """Cast where the text is a plain decimal; ``try_cast`` because filter order is not guaranteed."""
    text = as_column(text)
    return F.when(is_decimal(text), text.try_cast(type_name))
