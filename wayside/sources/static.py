"""Staged timetable text files."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date as Date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import blank_to_null
from ..schemas import STAGING_COLUMNS

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8", "enforceSchema": "false"}


def day_folder(root: str, day: Date | str) -> str:
    return f"{root.rstrip('/')}/{str(day).replace('-', '/')}"


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, on any file system Spark can reach."""
    files, hadoop_path = _file_system(spark, path)
    found = files.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def list_files(spark: SparkSession, pattern: str) -> set[str]:
    """Paths a glob matches, on any file system Spark can reach."""
    files, hadoop_path = _file_system(spark, pattern)
    return {str(status.getPath()) for status in files.globStatus(hadoop_path) or []}


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder this library wrote."""
    files, hadoop_path = _file_system(spark, path)
    files.delete(hadoop_path, True)


def staged_folder(spark: SparkSession, root: str, day: Date | str | None, today: Date | str) -> str:
    """Folder to load: the day asked for, else today's; a missing folder is an error either way.

    Falling back to an older folder would load stale data unnoticed.
    """
    folder = day_folder(root, day if day is not None else today)
    if not path_exists(spark, folder):
        raise FileNotFoundError(f"no staged files at {folder}")
    return folder


def normalise_columns(df: DataFrame) -> DataFrame:
    """Header names without byte order mark and blanks, in lower case."""
    return df.toDF(*[c.lstrip("﻿").strip().lower() for c in df.columns])


def blanks_to_nulls(df: DataFrame) -> DataFrame:
    """Empty and blank text becomes NULL; other text is kept as it is."""
    return df.select(*[F.when(blank_to_null(c).isNotNull(), F.col(c)).alias(c) for c in df.columns])


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited text table with header, all columns text."""
    df = spark.read.options(**CSV_OPTIONS).csv(path, inferSchema=False)
    return blanks_to_nulls(normalise_columns(df))


def read_static(spark: SparkSession, root: str, table: str, day: Date | str | None = None, today: Date | str = "") -> DataFrame:
    """One staged timetable table of a day, brought to the staging columns."""
    folder = staged_folder(spark, root, day, today or Date.today())
    return reconcile(read_text_table(spark, f"{folder}/{table}.txt"), STAGING_COLUMNS[table])


def read_timetable(spark: SparkSession, root: str, day: Date | str | None = None, today: Date | str = "") -> dict[str, DataFrame]:
    """All staged tables of a day."""
    return {table: read_static(spark, root, table, day, today) for table in STAGING_COLUMNS}


def extra_columns(df: DataFrame, staging: Sequence[str]) -> list[str]:
    """File columns the staging table does not know."""
    return [c for c in df.columns if c not in set(staging)]


def reconcile(df: DataFrame, staging: Sequence[str]) -> DataFrame:
    """Staging columns in order (absent ones NULL), then unknown file columns as text."""
    present = set(df.columns)
    known = [f"cast({f'`{c}`' if c in present else 'null'} as string) as `{c}`" for c in staging]
    return df.selectExpr(*known, *[f"cast(`{c}` as string) as `{c}`" for c in extra_columns(df, staging)])


def append_drifted(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union of frames whose columns drifted apart, by name."""
    return stored.unionByName(incoming, allowMissingColumns=True)


def read_feed_info(spark: SparkSession, path: str) -> DataFrame:
    """First record of feed_info; no row when the file is absent or holds only its header."""
    if not path_exists(spark, path):
        names = ("feed_publisher_name", "feed_publisher_url", "feed_lang", "feed_start_date", "feed_end_date", "feed_version")
        return spark.range(0).select(*[F.lit(None).cast("string").alias(c) for c in names])
    df = normalise_columns(spark.read.options(**CSV_OPTIONS).csv(path, inferSchema=False))
    return df.select(*[F.trim(c).alias(c) for c in df.columns]).limit(1)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Feed archives with their hash; the bytes are read by the tasks that hash them."""
    files = spark.read.format("binaryFile").load(path)
    ingested = F.col("modificationTime").cast("timestamp_ntz")
    return files.select(F.sha2("content", 256).alias("feedhash"), F.col("path").alias("sourceurl"), ingested.alias("ingestedat"))
