"""Decoded feed snapshots landed as ``<agency>/<feed>/<yyyy>/<mm>/<dd>/<HHmmss>.*``."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FEED_BODY

#: Path elements after the root: agency, feed, year, month, day.
PATH_PATTERN = r"/([^/]+)/([^/]+)/(\d{4})/(\d{2})/(\d{2})/[^/]+$"


def feed_glob(root: str, agency: str = "*", feed: str = "*", day: Date | str | None = None) -> str:
    """Glob of the snapshots of an agency, feed and day; omitted parts match everything."""
    date_part = str(day).replace("-", "/") if day is not None else "*/*/*"
    return f"{root.rstrip('/')}/{agency}/{feed}/{date_part}"


def path_columns(path) -> list:
    """Agency, feed and landing day of a snapshot's path."""
    parts = {i: F.regexp_extract(path, PATH_PATTERN, i) for i in range(1, 6)}
    return [
        parts[1].alias("agency_key"),
        parts[2].alias("feed_type"),
        F.try_to_date(F.concat(parts[3], parts[4], parts[5]), "yyyyMMdd").alias("landed_date"),
    ]


def with_path_parts(df: DataFrame) -> DataFrame:
    return df.select("*", *path_columns(F.col("_metadata.file_path")))


def read_feed(spark: SparkSession, root: str, agency: str = "*", feed: str = "*", day: Date | str | None = None, fmt: str = "json") -> DataFrame:
    """Decoded snapshots of an agency, feed and day."""
    return with_path_parts(spark.read.schema(FEED_BODY).format(fmt).load(feed_glob(root, agency, feed, day)))


def list_snapshots(spark: SparkSession, root: str, agency: str = "*", feed: str = "*", day: Date | str | None = None) -> DataFrame:
    """Landed files with size, agency, feed and day; file contents are not read."""
    files = spark.read.format("binaryFile").load(feed_glob(root, agency, feed, day)).select("path", "length")
    return files.select("path", "length", *path_columns(F.col("path")))


def compact_day(spark: SparkSession, root: str, out: str, day: Date | str, agency: str = "*", feed: str = "*", fmt: str = "json",
                target_bytes: int = 128 << 20) -> dict[str, int]:
    """Pack a landed day's many small snapshot files into few larger ones below ``out``, in the same folders; returns files per folder.

    Sizes come from the listing; each agency and feed gets as many files as its bytes need, and snapshots go to them by path, so
    that a rerun packs alike. Agency, feed and landing day are read from the folders, so every reader gives the same rows
    from ``out`` as from ``root``; what was landed stays as it is.
    """
    files = list_snapshots(spark, root, agency, feed, day)
    sizes = files.groupBy("agency_key", "feed_type").agg(F.sum("length").alias("bytes")).collect()
    made = {}
    for folder in sizes:  # one per agency and feed
        place = feed_glob("", folder["agency_key"], folder["feed_type"], day)
        count = made[place.strip("/")] = max(1, -(-folder["bytes"] // target_bytes))
        rows = spark.read.schema(FEED_BODY).format(fmt).load(f"{root.rstrip('/')}{place}")
        slot = F.pmod(F.xxhash64(F.col("_metadata.file_name")), F.lit(count))
        packed = rows.repartition(count, slot) if count > 1 else rows.coalesce(1)
        packed.write.mode("overwrite").format(fmt).save(f"{out.rstrip('/')}{place}")
    return made
