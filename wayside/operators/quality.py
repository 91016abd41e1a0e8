"""Timetable validation: every check of a table comes from one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import TIME_PATTERN
from .keys import orphans

# Columns a table must have.
REQUIRED_COLUMNS = {
    "agency": ["agency_id", "agency_name", "agency_url", "agency_timezone"],
    "routes": ["route_id", "agency_id", "route_short_name", "route_type"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "trips": ["route_id", "service_id", "trip_id"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"],
    "calendar": [
        "service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
        "start_date", "end_date",
    ],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"],
    "transfers": ["from_stop_id", "to_stop_id", "transfer_type"],
    "fare_attributes": ["fare_id", "price", "currency_type", "payment_method", "transfers"],
    "fare_rules": ["fare_id"],
    "feed_info": ["feed_publisher_name", "feed_publisher_url", "feed_lang"],
}

# Columns that must not be NULL.
KEY_COLUMNS = {
    "agency": ["agency_id", "agency_name"],
    "routes": ["route_id", "agency_id", "route_type"],
    "stops": ["stop_id", "stop_lat", "stop_lon"],
    "trips": ["trip_id", "route_id", "service_id"],
    "stop_times": ["trip_id", "stop_id", "stop_sequence", "departure_time"],
    "calendar": ["service_id"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "shapes": ["shape_id", "shape_pt_lat", "shape_pt_lon"],
}

# Primary keys.
PRIMARY_KEYS = {
    "trips": ["trip_id"],
    "stops": ["stop_id"],
    "routes": ["route_id"],
    "agency": ["agency_id"],
    "shapes": ["shape_id", "shape_pt_sequence"],
    "stop_times": ["trip_id", "stop_sequence"],
}

# Tables whose failure stops the run, and the size of the sample of bad values.
CRITICAL_TABLES = ("trips", "stops", "routes", "stop_times")
SAMPLE_SIZE = 5

#: (child, key, parent) references of the timetable format.
REFERENCES = (
    ("trips", "route_id", "routes"),
    ("stop_times", "trip_id", "trips"),
    ("stop_times", "stop_id", "stops"),
    ("routes", "agency_id", "agency"),
)

CHECK_SCHEMA = "table_name string, check_name string, failing bigint, total bigint, passed boolean"


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL count per column in one pass, one row per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "null_count")


def duplicate_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and their difference; keys with NULL parts count like any other.

    Counting per key and then over keys combines before the shuffle, so a key that repeats often
    costs one row per task.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_count"),
    )


def format_profile(df: DataFrame, column: str, pattern: str = TIME_PATTERN) -> DataFrame:
    """Rows and non-null values that do not match ``pattern``."""
    bad = F.col(column).isNotNull() & ~F.col(column).rlike(pattern)
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(bad).alias("invalid_format_count"))


def format_samples(df: DataFrame, column: str, pattern: str = TIME_PATTERN, count: int = SAMPLE_SIZE) -> DataFrame:
    """The first ``count`` values in order that do not match ``pattern``."""
    bad = df.filter(F.col(column).isNotNull() & ~F.col(column).rlike(pattern))
    return bad.select(column).orderBy(column).limit(count)


def check_columns(df: DataFrame, table: str) -> list[str]:
    """Required columns the frame lacks; reads the schema only."""
    actual = {c.lower() for c in df.columns}
    return [c for c in REQUIRED_COLUMNS.get(table, []) if c not in actual]


def check_table(df: DataFrame, table: str) -> DataFrame:
    """All checks of one table as rows ``CHECK_SCHEMA``, from a single pass over the data.

    The pass groups by primary key where one is declared: each key yields its row count, null
    counts and format errors, which then add up over keys.
    """
    missing = check_columns(df, table)
    actual = {c.lower() for c in df.columns}
    nulls = KEY_COLUMNS.get(table, [])
    keys = PRIMARY_KEYS.get(table, [])
    timed = table == "stop_times"

    measures = {"_rows": F.count(F.lit(1))}
    present = [F.col(c).isNull().cast("int") for c in nulls if c in actual]
    if present:
        measures["_nulls"] = F.coalesce(F.sum(sum(present[1:], present[0])), F.lit(0))
    if timed and "departure_time" in actual:
        value = F.col("departure_time")
        measures["_bad_time"] = F.count_if(value.isNotNull() & ~value.rlike(TIME_PATTERN))
    keyed = bool(keys) and not [c for c in keys if c not in actual]
    if keyed:
        parts = df.groupBy(*keys).agg(*[m.alias(name) for name, m in measures.items()])
        sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in measures]
        totals = parts.agg(*sums, F.count(F.lit(1)).alias("_keys"))
    else:
        totals = df.agg(*[m.alias(name) for name, m in measures.items()])

    total = F.col("_rows")
    checks = [("row_counts", F.when(total == 0, 1).otherwise(0))]
    checks.append(("required_columns", F.lit(len(missing))))
    if nulls:
        # A column that is absent fails as if it were NULL throughout, and at least once.
        failing = [F.col("_nulls")] * bool(present) + [F.greatest(total, F.lit(1)) for c in nulls if c not in actual]
        checks.append(("null_checks", sum(failing[1:], failing[0])))
    if timed:
        bad = F.col("_bad_time") if "departure_time" in actual else F.greatest(total, F.lit(1))
        checks.append(("departure_time_format", bad))
    if keys:
        checks.append(("duplicate_checks", total - F.col("_keys") if keyed else F.greatest(total, F.lit(1))))
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), c.cast("bigint").alias("failing")) for n, c in checks])
    unfolded = totals.select(total.cast("bigint").alias("total"), F.explode(rows).alias("_c"))
    return unfolded.select(
        F.lit(table).alias("table_name"),
        F.col("_c.check_name").alias("check_name"),
        F.col("_c.failing").alias("failing"),
        "total",
        (F.col("_c.failing") == 0).alias("passed"),
    )


def missing_table(spark, table: str) -> DataFrame:
    """The single failed check of a table that could not be read."""
    return spark.range(1).select(
        F.lit(table).alias("table_name"),
        F.lit("load").alias("check_name"),
        F.lit(1).cast("bigint").alias("failing"),
        F.lit(0).cast("bigint").alias("total"),
        F.lit(False).alias("passed"),
    )


def check_tables(spark, tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Check rows of all tables in one frame; ``None`` stands for a table that could not be read."""
    parts = [missing_table(spark, t) if df is None else check_table(df, t) for t, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def verdicts(checks: DataFrame) -> DataFrame:
    """One row per table: row count, and whether each check and all of them passed."""
    def passed(name: str):
        return F.coalesce(F.bool_and(F.when(F.col("check_name") == name, F.col("passed"))), F.lit(True))

    return checks.groupBy("table_name").agg(
        F.max("total").alias("row_count"),
        passed("required_columns").alias("required_columns_passed"),
        passed("null_checks").alias("null_check_passed"),
        passed("duplicate_checks").alias("duplicate_check_passed"),
        F.bool_and("passed").alias("overall_passed"),
        (~F.bool_and("passed") & F.col("table_name").isin(*CRITICAL_TABLES)).alias("critical_failure"),
    )


def summary(table_verdicts: DataFrame) -> DataFrame:
    """Run summary: tables passed and failed, and whether the run must stop."""
    return table_verdicts.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if("overall_passed").alias("passed"),
        F.count_if(~F.col("overall_passed")).alias("failed"),
        F.coalesce(F.bool_and("overall_passed"), F.lit(True)).alias("overall_passed"),
        F.coalesce(F.bool_or("critical_failure"), F.lit(False)).alias("must_stop"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("overall_passed"), F.col("table_name")))), ",").alias("failed_tables"),
    )


def require_no_critical(table_verdicts: DataFrame) -> None:
    """Raise if a critical table failed (there are at most four)."""
    failed = [r.table_name for r in table_verdicts.filter("critical_failure").select("table_name").collect()]
    if failed:
        raise ValueError(f"critical tables failed validation: {sorted(failed)}")


def reference_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Orphaned rows per declared reference."""
    parts = []
    for child, key, parent in REFERENCES:
        lost = orphans(tables[child], tables[parent], key).agg(F.count(F.lit(1)).alias("orphan_count"))
        parts.append(lost.select(F.lit(child).alias("child"), F.lit(key).alias("key"), F.lit(parent).alias("parent"), "orphan_count"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def preflight(dims: Mapping[str, DataFrame], *needed: str) -> None:
    """Raise unless every needed dimension has a row with a positive key."""
    empty = [name for name in needed if dims[name].filter(F.col(f"{name}key") > 0).isEmpty()]
    if empty:
        raise ValueError(f"dimensions must be loaded first: {empty}")


def preflight_counts(dims: Mapping[str, DataFrame], *needed: str) -> DataFrame:
    """Rows with a positive key per dimension."""
    parts = []
    for name in needed:
        counted = dims[name].agg(F.count_if(F.col(f"{name}key") > 0).alias("row_count"))
        parts.append(counted.select(F.lit(name).alias("dimension"), "row_count"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def days_without_pings(positions: DataFrame, dates: DataFrame) -> DataFrame:
    """Dates for which no vehicle reported; merging them leaves every trip missed (a warning)."""
    seen = positions.select(F.col("timestamp_local").cast("date").alias("service_date")).distinct()
    return dates.join(seen, "service_date", "left_anti")
