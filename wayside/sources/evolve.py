"""Stored tables whose columns drift from day to day."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import columns_of
from .sinks import read_table, replace_partition

COLUMNS = "column_name string, first_day date"


def extra_of(df: DataFrame, ddl: str, *partition: str) -> list[str]:
    """Columns a frame has beyond the contract."""
    known = {name for name, _ in columns_of(ddl)} | set(partition)
    return [c for c in df.columns if c not in known]


def write_evolved(df: DataFrame, path: str, day: Date, ddl: str, day_column: str = "load_date") -> list[str]:
    """Store the rows of ``day`` in a partition of their own, replacing what it had; returns the columns that are new to the table.

    Columns beyond the contract are kept as text. Each is noted once, with the day it first came, in ``<path>_columns``: readers know all
    columns of the table without opening its files.
    """
    spark = df.sparkSession
    extra = extra_of(df, ddl)
    known = {r["column_name"] for r in read_table(spark, f"{path}_columns", COLUMNS).collect()}
    fresh = [c for c in extra if c not in known]
    if fresh:
        noted = spark.createDataFrame([(c, day) for c in fresh], COLUMNS)
        noted.coalesce(1).write.mode("append").parquet(f"{path}_columns")
    contract = [F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in columns_of(ddl)]
    rows = df.select(*contract, *[F.col(f"`{c}`").cast("string").alias(c) for c in extra], F.lit(day).alias(day_column))
    replace_partition(rows, path, day_column)
    return fresh


def read_evolved(spark: SparkSession, path: str, ddl: str, day_column: str = "load_date") -> DataFrame:
    """All days together: the contract's columns, then every column that ever came, NULL on days without it.

    The schema is given, so no footers are merged; files lacking a column read as NULL. A contract that has since taken up a noted column wins.
    """
    noted = read_table(spark, f"{path}_columns", COLUMNS).groupBy("column_name").agg(F.min("first_day").alias("first_day"))
    known = {name for name, _ in columns_of(ddl)}
    extra = [r["column_name"] for r in noted.orderBy("first_day", "column_name").collect() if r["column_name"] not in known]
    return read_table(spark, path, ", ".join([ddl, *[f"`{c}` string" for c in extra], f"{day_column} date"]))
