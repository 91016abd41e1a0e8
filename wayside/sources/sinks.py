"""Writers: full refresh, day partitions, reports and extracts."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date as Date
from datetime import timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import keep_latest
from ..operators.quality import summary, verdicts
from ..schemas import columns_of
from ..session import scratch_path, settings
from .static import delete_path, list_files, path_exists


def overwrite_table(df: DataFrame, path: str) -> None:
    """Full refresh of a staging table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def replace_partition(df: DataFrame, path: str, *columns: str) -> None:
    """Replace exactly the partitions ``df`` has rows for; the others stay.

    The rebalance hint gathers each partition's rows before the write, and adaptive execution
    splits a large day over several tasks and merges small ones, so neither one hot day nor
    hundreds of tiny files result. ``df`` may read the table it replaces: new files are written
    aside and swapped in once all tasks have succeeded.
    """
    spread = df.hint("rebalance", *columns)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


#: Inside these, frames partitioned by a bucketed table's columns join it on more columns without moving, and a task writes the files of its days
#: side by side instead of sorting its rows by day. Tables that are rewritten again and again are worth the tighter codec.
IN_PLACE = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.maxConcurrentOutputFileWriters": "100",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}
#: Bytes of source files that one bucket stands for, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 4


def buckets_for(source: DataFrame) -> int:
    """How many buckets a table made of the rows of ``source`` gets."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))


@dataclass(frozen=True)
class Bucketed:
    """A table at ``path`` by day whose days are laid out in the same ``buckets`` of ``keys``.

    Rows never move between days or buckets, so a task that has a bucket of all days joins and rewrites it in place. The catalog
    knows the layout; the files, one for each day and bucket, are plain ones that any reader of the folder finds. All writing goes through ``replace``.
    """

    path: str
    ddl: str
    partition: str
    keys: tuple[str, ...]
    buckets: int

    @property
    def name(self) -> str:
        return f"by_{self.partition}_{hashlib.md5(f'{self.path} {self.keys} {self.buckets}'.encode()).hexdigest()[:16]}"

    def rows(self, spark: SparkSession) -> DataFrame:
        """The stored rows, each task's of one bucket where that spares a move."""
        columns = columns_of(self.ddl)
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} ({', '.join(f'{c} {kind}' for c, kind in columns)}) USING parquet PARTITIONED BY ({self.partition})"
                f" CLUSTERED BY ({', '.join(self.keys)}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
            if path_exists(spark, self.path):  # what an earlier application has stored
                spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
        spark.catalog.refreshTable(self.name)
        return spark.table(self.name).select(*[c for c, _ in columns])

    def replace(self, df: DataFrame) -> None:
        """Replace exactly the days ``df`` has rows for; it should come in ``buckets`` partitions by ``keys``, and may read the table."""
        spark = df.sparkSession
        self.rows(spark)
        columns = [c for c, _ in columns_of(self.ddl) if c != self.partition]
        with settings(spark, IN_PLACE):
            df.select(*columns, self.partition).write.mode("overwrite").insertInto(self.name)

    def forget(self, spark: SparkSession) -> None:
        """Take the table out of the catalog; its files stay."""
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _files(spark: SparkSession, path: str, column: str, days) -> dict:
    """Data files of each day of a table, by day, from one listing."""
    found: dict = {day: set() for day in days}
    named = {str(day): day for day in days}
    if named:
        for file in list_files(spark, f"{path}/{column}={{{','.join(named)}}}/*"):
            found[named[file.rsplit(f"/{column}=", 1)[1].split("/")[0]]].add(file)
    return found


def replace_days(df: DataFrame, path: str, column: str, wanted: DataFrame) -> list:
    """Replace the partitions of all ``wanted`` days; those ``df`` has no rows for are removed.

    ``wanted`` holds ``column`` and is a short list. A day whose files are still the old ones after the write got no rows.
    A run that fails before the removal leaves old days in place and may be repeated. Returns the days removed.
    """
    spark = df.sparkSession
    days = sorted(row[0] for row in wanted.select(column).distinct().collect())
    before = _files(spark, path, column, days)
    replace_partition(df, path, column)
    after = _files(spark, path, column, days)
    emptied = [day for day in days if before[day] and before[day] == after[day]]
    for day in emptied:
        delete_path(spark, f"{path}/{column}={day}")
    return emptied


def write_day(df: DataFrame, path: str, *days, day_column: str = "service_date") -> bool:
    """Store parsed feed rows per agency and day, replacing what the same agencies and days had.

    An empty frame replaces nothing. Returns whether any of ``days`` got rows.
    """
    spark = df.sparkSession
    before = _files(spark, f"{path}/*", day_column, days)
    replace_partition(df, path, "agency_key", day_column)
    return _files(spark, f"{path}/*", day_column, days) != before


@dataclass(frozen=True)
class Landed:
    """What a load read, kept after removing repeats, and wrote; the days it touched, and whether its own day got rows."""

    read: int = 0
    kept: int = 0
    written: int = 0
    days: tuple = ()
    own_day: bool = False

    def __bool__(self) -> bool:
        return self.own_day


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The frame, and the count of its rows once it has been written: no pass of its own."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def merge_landed(df: DataFrame, path: str, day: Date, keys: Sequence[str], newest: Sequence[str], day_column: str = "service_date",
                 reach: int = 2) -> Landed:
    """Store the rows that landed on ``day`` per agency and service day, next to those that landed on other days.

    Each stored row knows its ``landed_date``. The load takes the place of all rows that landed on ``day``: in the agency-days
    it has rows for, and in those within ``reach`` days of ``day`` where an earlier load of it had. Rows of other landing days stay there, and of rows
    with the same ``keys`` the newest is kept. Only these agency-days are read and rewritten.
    """
    spark = df.sparkSession
    aside = scratch_path(spark, "landed-rows")
    place = ["agency_key", day_column]
    unique = list(dict.fromkeys([*place, *keys]))
    try:
        rows, read = counted(df)
        rows, kept = counted(keep_latest(rows, unique, newest).withColumn("landed_date", F.lit(day)))
        rows.write.partitionBy(*place).parquet(aside)
        fresh = spark.read.schema(rows.schema).parquet(aside)
        touched = {tuple(r) for r in fresh.select(*place).distinct().collect()}
        others, earlier = None, set()
        if path_exists(spark, path):
            near = [day + timedelta(days=n) for n in range(-reach, reach + 1)]
            stored = spark.read.schema(rows.schema).parquet(path).select(*rows.columns)
            stored = stored.withColumn("landed_date", F.coalesce("landed_date", day_column))
            mine = stored.filter(F.col(day_column).isin(near) & (F.col("landed_date") == F.lit(day)))
            earlier = {tuple(r) for r in mine.select(*place).distinct().collect()}
            where = sorted(touched | earlier)
            pairs = F.struct(*place).isin([F.struct(F.lit(a), F.lit(d)) for a, d in where])
            inside = F.col("agency_key").isin(sorted({a for a, _ in where})) & F.col(day_column).isin(sorted({d for _, d in where}))
            others = stored.filter(inside & pairs & (F.col("landed_date") != F.lit(day))) if where else None
        result = fresh if others is None else keep_latest(fresh.unionByName(others), unique, newest)
        result, written = counted(result)
        before = {p: list_files(spark, f"{path}/agency_key={p[0]}/{day_column}={p[1]}/*") for p in earlier}
        replace_partition(result, path, *place)
        for agency, d in earlier - touched:
            folder = f"{path}/agency_key={agency}/{day_column}={d}"
            if list_files(spark, f"{folder}/*") == before[agency, d]:
                delete_path(spark, folder)
    finally:
        delete_path(spark, aside)
    days = tuple(sorted({d for _, d in touched | earlier}))
    return Landed(read.get["rows"], kept.get["rows"], written.get["rows"], days, any(d == day for _, d in touched))


def write_report(checks: DataFrame, path: str) -> DataFrame:
    """Validation report as JSON: check rows, one row per table and the summary; returns the rows per table.

    The tables are scanned once, for the check rows; the rest is derived from what was written.
    """
    checks.write.mode("overwrite").json(f"{path}/checks")
    spark = checks.sparkSession
    verdicts(spark.read.schema(checks.schema).json(f"{path}/checks")).write.mode("overwrite").json(f"{path}/tables")
    per_table = spark.read.schema(verdicts(checks).schema).json(f"{path}/tables")
    summary(per_table).write.mode("overwrite").json(f"{path}/summary")
    return per_table


# Views served as extracts.
EXTRACTS = (
    "missed_rate_by_route", "otp_by_route_month", "routes_consistently_late", "voms", "daily_hours", "daily_miles",
)


def refresh_extracts(views: Mapping[str, DataFrame], out: str, names: tuple[str, ...] = EXTRACTS) -> list[str]:
    """Full refresh of the served copy of each view; returns the names written."""
    for name in names:
        views[name].write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{out}/{name}")
    return list(names)


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A stored table with its contract's columns; an absent table reads as empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], ddl)
    columns = [name for name, _ in columns_of(ddl)]
    return spark.read.schema(ddl).parquet(path).select(*columns)
