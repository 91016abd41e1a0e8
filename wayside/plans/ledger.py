"""The run ledger: what every load did, step by step."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date as Date
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import keep_latest
from ..sources.sinks import read_table

ENTRY = (
    "run_id string, step string, run_date date, started timestamp_ntz, ended timestamp_ntz, status string, rows_read bigint, rows_kept bigint,"
    " rows_written bigint, is_new_version boolean, file_count int, feed_key string, feed_hash string, error string"
)
RUNNING, SUCCEEDED, FAILED = "RUNNING", "SUCCEEDED", "FAILED"


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


@dataclass
class Step:
    """A step under way; what is set here goes into its entry."""

    figures: dict = field(default_factory=dict)
    #: Whether an earlier attempt of the same run has finished it.
    done: bool = False

    def note(self, **figures) -> None:
        self.figures.update(figures)


@dataclass
class Ledger:
    """An append-only table of entries; a step tried again adds one, and the last of each run and step counts."""

    spark: SparkSession
    path: str

    def attempts(self) -> DataFrame:
        """Every entry ever written."""
        return read_table(self.spark, self.path, ENTRY)

    def entries(self) -> DataFrame:
        """The last entry of each run and step."""
        return keep_latest(self.attempts(), ["run_id", "step"], ["started", "ended"])

    def finished(self, run_id: str) -> set[str]:
        """Steps of a run that have succeeded."""
        rows = self.attempts().filter((F.col("run_id") == run_id) & (F.col("status") == SUCCEEDED)).select("step").distinct()
        return {r["step"] for r in rows.collect()}

    def _append(self, **values) -> None:
        names = [c.strip().split(" ")[0] for c in ENTRY.split(",")]
        row = self.spark.createDataFrame([tuple(values.get(n) for n in names)], ENTRY)
        row.coalesce(1).write.mode("append").partitionBy("run_date").parquet(self.path)

    @contextmanager
    def step(self, run_id: str, name: str, day: Date) -> Iterator[Step]:
        """Run a step: ``done`` tells that it has succeeded before and should be skipped; an error is noted and raised again."""
        here = Step(done=name in self.finished(run_id))
        if here.done:
            yield here
            return
        started = now()
        common = {"run_id": run_id, "step": name, "run_date": day, "started": started}
        try:
            yield here
        except Exception as error:
            self._append(**common, ended=now(), status=FAILED, **here.figures, error=f"{type(error).__name__}: {str(error)[:500]}")
            raise
        self._append(**common, ended=now(), status=SUCCEEDED, **here.figures)


def runs(entries: DataFrame, step: str = "timetable") -> DataFrame:
    """Runs for the daily digest, one per run: failed if any of its steps is; what is new comes from ``step``."""
    of = F.col("step") == step
    return entries.groupBy("run_id", "run_date").agg(
        F.max("ended").alias("run_timestamp"),
        F.when(F.count_if(F.col("status") == FAILED) > 0, FAILED).otherwise(SUCCEEDED).alias("status"),
        F.coalesce(F.bool_or(F.when(of, F.col("is_new_version"))), F.lit(False)).alias("is_new_version"),
        F.coalesce(F.sum(F.when(of, F.col("file_count"))), F.lit(0)).cast("int").alias("file_count"),
        F.max("error").alias("error"),
    ).drop("run_id")


def versions_seen(entries: DataFrame) -> DataFrame:
    """The day each feed hash was last loaded."""
    loaded = entries.filter(F.col("feed_hash").isNotNull() & (F.col("status") == SUCCEEDED))
    return loaded.groupBy(F.col("feed_hash").alias("feedhash")).agg(F.max("run_date").alias("last_seen_date"))


def manifests(entries: DataFrame, step: str = "timetable") -> DataFrame:
    """Load manifests per feed, as ``latest_manifest`` takes them."""
    loaded = entries.filter((F.col("step") == step) & (F.col("status") == SUCCEEDED) & F.col("feed_key").isNotNull())
    return loaded.select("feed_key", F.col("run_date").alias("load_date"), "feed_hash", "is_new_version", "file_count")
