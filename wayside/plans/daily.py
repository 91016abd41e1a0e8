"""The daily run: stop fact, then trip fact, then service-day fact, over any range of days."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date as Date
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flags
from ..functions.clock import DEFAULT_ZONE, date_key, service_day
from ..operators import audit, gaps
from ..operators import days as day_ops
from ..operators import stops as stop_ops
from ..operators import trips as trip_ops
from ..operators.calendar import date_range
from ..operators.flatten import flatten_trip_updates, flatten_vehicle_positions, valid_snapshots
from ..operators.keys import narrow, newest_dims
from ..operators.latest import keep_latest
from ..operators.quality import check_tables, preflight, require_no_critical
from ..schemas import FACT_SERVICE_DAY, FACT_STOP, FACT_TRIP, STAGING_COLUMNS, STOP_UPDATES, VEHICLE_POSITIONS
from ..sources.feeds import feed_glob, read_feed
from ..sources.sinks import Landed, counted, merge_landed, overwrite_table, read_table, replace_days, write_report
from ..sources.static import path_exists, read_feed_info, read_static, staged_folder
from .dimstore import DimensionStore
from .ledger import Ledger

Frames = Mapping[str, DataFrame]
PHASES = ("skeleton", "merge", "both")


@dataclass(frozen=True)
class Options:
    """Choices of a run, as the operators document them."""

    #: Pings before this hour belong to the day before.
    cutoff_hour: int = 0
    #: Feed names of agencies (agency_key) and their timetable ids (agencyid).
    agency_ids: DataFrame | None = None
    #: Miles of added trips: "hours", or None for none.
    added_vrm: str | None = "hours"
    #: Whether merged trips count as estimated.
    estimated_scope: bool = True
    #: Rule for trips past midnight in the peak count, "wrap" or "clock".
    overnight: str = "wrap"


def _check_phase(phase: str) -> None:
    if phase not in PHASES:
        raise ValueError(f"phase must be one of {PHASES}, not {phase!r}")


def on_dates(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """Fact rows of the dates; other partitions of a table laid out by date key are not opened."""
    return narrow(fact, "datekey", dates.select(date_key("service_date").alias("datekey")))


def kept_rows(stored: DataFrame | None, dates: DataFrame, phase: str) -> DataFrame | None:
    """Stored rows of the dates; None where a skeleton finds none, so that its rows are not moved to be compared with nothing."""
    if stored is None:
        return None
    kept = on_dates(stored, dates)
    return None if phase != "merge" and kept.isEmpty() else kept


def pings_on(positions: DataFrame, dates: DataFrame, cutoff_hour: int = 0) -> DataFrame:
    """Pings of the service days; the bounds on the time itself can skip row groups."""
    if "service_date" in positions.columns:  # stored by day: other partitions are not opened
        positions = narrow(positions, "service_date", dates)
    first, last = (dates.agg(f("service_date")).scalar() for f in (F.min, F.max))
    at = F.col("timestamp_local")
    shift = F.make_dt_interval(F.lit(0), F.lit(cutoff_hour), F.lit(0), F.lit(0))
    after, before = first.cast("timestamp_ntz") + shift, F.date_add(last, 1).cast("timestamp_ntz") + shift
    days = positions.filter((at >= after) & (at < before)).withColumn("_day", service_day(at, cutoff_hour))
    wanted = dates.select(F.col("service_date").alias("_day")).distinct()
    return days.join(wanted, "_day", "left_semi").select(*positions.columns)


def build_stop_fact(stg: Frames, dims: Frames, updates: DataFrame, dates: DataFrame, stored: DataFrame | None = None,
                    phase: str = "both", force: bool = False) -> DataFrame:
    """Stop fact rows of the dates after the phase: stored rows plus new ones, merged and flagged."""
    _check_phase(phase)
    dims = newest_dims(dims)
    kept = kept_rows(stored, dates, phase)
    fact = kept
    if phase != "merge":
        fresh = stop_ops.stop_skeleton(stg, dims, dates, kept)
        fact = fresh if kept is None else kept.unionByName(fresh)
    if fact is None:
        raise ValueError("the merge phase needs stored rows")
    if phase != "skeleton":
        reported = narrow(updates, "service_date", dates)
        fact = stop_ops.stop_official(stop_ops.merge_stop_updates(fact, reported, dims, force))
    return fact


def build_trip_fact(stg: Frames, dims: Frames, positions: DataFrame, dates: DataFrame, stored: DataFrame | None = None,
                    phase: str = "both", force: bool = False, force_skeleton: bool = False, options: Options = Options()) -> DataFrame:
    """Trip fact rows of the dates after the phase; ``force_skeleton`` forgets the stored rows."""
    _check_phase(phase)
    dims = newest_dims(dims)
    kept = kept_rows(stored, dates, phase)
    if kept is not None and phase != "skeleton":
        kept = kept.filter(F.col("tripstatus") != flags.ADDED)  # all of one key, and found anew below
    fact = kept
    if phase != "merge":
        base = None if force_skeleton else kept
        fresh = trip_ops.trip_skeleton(stg, dims, dates, base)
        fact = fresh if base is None else base.unionByName(fresh)
    if fact is None:
        raise ValueError("the merge phase needs stored rows")
    if phase != "skeleton":
        pings = pings_on(positions, dates, options.cutoff_hour)
        fact = trip_ops.merge_pings(fact, pings, dims, force, options.estimated_scope, options.cutoff_hour)
        added = trip_ops.added_trips(pings, stg["trips"], dims, options.cutoff_hour, options.added_vrm, options.agency_ids)
        fact = trip_ops.replace_added(fact, added)
        fact = trip_ops.trip_official(fact)
    return fact


# What identifies a stored feed row.
UPDATE_KEYS = ["agency_key", "trip_id", "stop_id", "stop_sequence", "service_date"]
POSITION_KEYS = ["agency_key", "vehicle_id", "timestamp_utc"]


@dataclass
class Warehouse:
    """Where staging, dimensions, facts and the run ledger are stored: one parquet table each, facts partitioned by date key and
    feed rows by agency and service day.

    Every load writes its steps into the ledger. A load that is given the ``run_id`` of one that failed skips the steps that one has finished.
    """

    spark: SparkSession
    root: str
    options: Options = field(default_factory=Options)

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _store(self, fact: DataFrame, name: str, dates: DataFrame) -> None:
        """Replace the table's rows of exactly these dates, also of those that came out empty."""
        replace_days(fact, self._path(name), "datekey", dates.select(date_key("service_date").alias("datekey")))

    def stop(self) -> DataFrame:
        return read_table(self.spark, self._path("fact_stop"), FACT_STOP)

    def trip(self) -> DataFrame:
        return read_table(self.spark, self._path("fact_trip"), FACT_TRIP)

    def day(self) -> DataFrame:
        return read_table(self.spark, self._path("fact_service_day"), FACT_SERVICE_DAY)

    def updates(self) -> DataFrame:
        return read_table(self.spark, self._path("rt_stop_time_updates"), STOP_UPDATES)

    def positions(self) -> DataFrame:
        return read_table(self.spark, self._path("rt_vehicle_positions"), f"{VEHICLE_POSITIONS}, service_date date")

    def staging(self) -> dict[str, DataFrame]:
        columns = {name: ", ".join(f"{c} string" for c in names) for name, names in STAGING_COLUMNS.items()}
        return {name: read_table(self.spark, self._path(f"stg_{name}"), ddl) for name, ddl in columns.items()}

    @property
    def dimensions(self) -> DimensionStore:
        return DimensionStore(self.spark, self._path("dims"))

    @property
    def ledger(self) -> Ledger:
        return Ledger(self.spark, self._path("run_ledger"))

    def versions(self) -> DataFrame:
        return self.dimensions.versions()

    def validations(self) -> DataFrame:
        """``run_date, overall_passed, passed, total_tables``: the verdict on every timetable day, from the reports that the loads have left."""
        ddl, reports = "overall_passed boolean, passed bigint, total_tables bigint", self._path("validation/*/summary")
        if not path_exists(self.spark, reports):
            return self.spark.createDataFrame([], f"run_date date, {ddl}")
        day = F.regexp_extract(F.col("_metadata.file_path"), "/validation/([0-9-]+)/summary/", 1).cast("date")
        return self.spark.read.schema(ddl).json(reports).select(day.alias("run_date"), "*")

    def load_feed_day(self, root: str, day: Date, dims: Frames | None = None, zone: str = DEFAULT_ZONE, fmt: str = "json",
                      run_id: str | None = None) -> dict[str, Landed]:
        """One landed feed day: drop junk, flatten, keep the newest rows, store them, then set times of operated trips.

        A position belongs to its local day, one without a time to ``day``. Rows of other service days join what other landing days have
        stored for them. Returns per table what was read and stored, true where ``day`` itself got rows; a feed that did not
        land changes nothing. ``dims`` default to the stored dimensions as of ``day``.
        """
        run, cutoff = run_id or uuid.uuid4().hex, self.options.cutoff_hour
        stored = {"rt_stop_time_updates": Landed(), "rt_vehicle_positions": Landed()}

        def load(feed: str, table: str, keys: list[str], flatten) -> None:
            with self.ledger.step(run, feed, day) as step:
                if step.done or not path_exists(self.spark, feed_glob(root, feed=feed, day=day)):
                    return
                rows = flatten(valid_snapshots(read_feed(self.spark, root, feed=feed, day=day, fmt=fmt)))
                stored[table] = done = merge_landed(rows, self._path(table), day, keys, ["feed_timestamp_utc"])
                step.note(rows_read=done.read, rows_kept=done.kept, rows_written=done.written)

        def placed(vehicles: DataFrame) -> DataFrame:
            rows = flatten_vehicle_positions(vehicles, zone)
            return rows.withColumn("service_date", F.coalesce(service_day("timestamp_local", cutoff), F.lit(day)))

        load("trip-updates", "rt_stop_time_updates", UPDATE_KEYS, lambda v: flatten_trip_updates(v, zone, cutoff))
        load("vehicle-positions", "rt_vehicle_positions", POSITION_KEYS, placed)
        days = stored["rt_vehicle_positions"].days
        if days and path_exists(self.spark, self._path("fact_trip")):
            with self.ledger.step(run, "actual-times", day) as step:
                if not step.done:
                    touched = self.spark.createDataFrame([(d,) for d in days], "service_date date")
                    self.backfill_times(dims or self.dimensions.as_of(day), self.positions(), touched)
        return stored

    def load_timetable_day(self, root: str, day: Date, feeds: DataFrame | None = None, feed_key: str | None = None,
                           run_id: str | None = None) -> bool:
        """One staged timetable day: skip a known feed, check, stop on a critical failure, refresh staging and dimensions.

        ``feeds`` (feedhash, ingestedat, …) are the archives the files came from; with none of them new, nothing is
        done and False is returned. They are registered with the dates and publisher of ``feed_info``, and the dimensions
        follow the new tables; without ``feeds`` only staging is refreshed. A table that did not come is empty afterwards, unless the
        checks need it. The report of the checks stays in ``validation/<day>``.
        """
        with self.ledger.step(run_id or uuid.uuid4().hex, "timetable", day) as step:
            if step.done:
                return True
            step.note(feed_key=feed_key)
            if feeds is not None:
                fresh = audit.is_new_version(feeds, self.versions()).agg(F.max(F.struct("ingestedat", "feedhash")).alias("last")).first()["last"]
                known = feeds.agg(F.max(F.struct("ingestedat", "feedhash")).alias("last")).first()["last"]
                step.note(is_new_version=fresh is not None, feed_hash=known["feedhash"] if known else None)
                if fresh is None:
                    return False
            folder = staged_folder(self.spark, root, day, day)
            present = [name for name in STAGING_COLUMNS if path_exists(self.spark, f"{folder}/{name}.txt")]
            frames = {name: read_static(self.spark, root, name, day) for name in present}
            checks = check_tables(self.spark, {name: frames.get(name) for name in STAGING_COLUMNS})
            require_no_critical(write_report(checks, self._path(f"validation/{day}")))
            written = 0
            for name, columns in STAGING_COLUMNS.items():
                absent = self.spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
                rows, seen = counted(frames.get(name, absent))
                overwrite_table(rows, self._path(f"stg_{name}"))
                written += seen.get["rows"]
            step.note(rows_written=written, file_count=len(present))
            if feeds is not None:
                about = audit.describe_feed(read_feed_info(self.spark, f"{folder}/feed_info.txt"))
                described = feeds.withColumns({c: about.select(c).scalar() for c in about.columns if c not in feeds.columns})
                self.dimensions.load(self.staging(), day, described.withColumn("filecount", F.lit(len(present)).cast("smallint")))
            return True

    def load_stops(self, stg: Frames, dims: Frames, updates: DataFrame, dates: DataFrame, phase: str = "both", force: bool = False) -> None:
        if phase != "merge":
            preflight(dims, "trip")
        fact = build_stop_fact(stg, dims, updates, dates, self.stop(), phase, force)
        self._store(fact, "fact_stop", dates)

    def load_trips(self, stg: Frames, dims: Frames, positions: DataFrame, dates: DataFrame, phase: str = "both",
                   force: bool = False, force_skeleton: bool = False) -> None:
        if phase != "merge":
            preflight(dims, "trip", "shape")
        fact = build_trip_fact(stg, dims, positions, dates, self.trip(), phase, force, force_skeleton, self.options)
        self._store(fact, "fact_trip", dates)

    def load_days(self, dates: DataFrame) -> None:
        self._store(day_ops.service_day(on_dates(self.trip(), dates), self.options.overnight), "fact_service_day", dates)

    def backfill_times(self, dims: Frames, positions: DataFrame, dates: DataFrame) -> None:
        """Early start and end times of trips already operated, right after a feed day is parsed."""
        stored = on_dates(self.trip(), dates)
        pings = pings_on(positions, dates, self.options.cutoff_hour)
        timed = trip_ops.backfill_actual_times(stored.filter("tripkey > 0"), pings, newest_dims(dims), self.options.cutoff_hour)
        self._store(timed.unionByName(stored.filter("tripkey = 0")), "fact_trip", dates)

    def work_list(self, updates: DataFrame, positions: DataFrame, as_of, lookback: int = gaps.LOOKBACK_DAYS) -> DataFrame:
        """What is left to do, per job."""
        found = gaps.gap_dates(updates, positions, self.stop(), self.trip(), self.day(), as_of, lookback)
        return gaps.work_list(found)

    def run(self, stg: Frames, dims: Frames, updates: DataFrame, positions: DataFrame, dates: DataFrame,
            phase: str = "both", force: bool = False) -> None:
        """All three facts for the dates, in order: each reads what the one before wrote."""
        self.load_stops(stg, dims, updates, dates, phase, force)
        self.load_trips(stg, dims, positions, dates, phase, force)
        if phase != "skeleton":
            self.load_days(dates)

    def run_work_list(self, stg: Frames, dims: Frames, updates: DataFrame, positions: DataFrame, as_of) -> DataFrame:
        """Run exactly the days the inspection found; returns the list as it was found (at most three rows)."""
        work = self.work_list(updates, positions, as_of)
        found = work.collect()
        todo = {row.job: row for row in found}
        def dates_of(job):
            days = [F.lit(d) for d in todo[job].gap_dates]
            return self.spark.range(1).select(F.explode(F.array(*days)).alias("service_date"))

        if not todo[gaps.STOP_JOB].skip:
            self.load_stops(stg, dims, updates, dates_of(gaps.STOP_JOB), todo[gaps.STOP_JOB].phase)
        if not todo[gaps.TRIP_JOB].skip:
            self.load_trips(stg, dims, positions, dates_of(gaps.TRIP_JOB), todo[gaps.TRIP_JOB].phase)
        if not todo[gaps.DAY_JOB].skip:
            self.load_days(dates_of(gaps.DAY_JOB))
        return self.spark.createDataFrame(found, work.schema)

    def run_range(self, stg: Frames, dims: Frames, updates: DataFrame, positions: DataFrame, start: Date, end: Date,
                  phase: str = "both", force: bool = False, days_per_job: int | None = None, run_id: str | None = None) -> None:
        """Backfill a range. One job handles it all unless ``days_per_job`` splits it; a failing
        part does not stop the others, and all failures are raised together at the end. Called again with the same
        ``run_id`` and parts, it does those that the ledger does not list as finished."""
        if start > end:
            raise ValueError(f"start {start} is after end {end}")
        length = days_per_job or (end - start).days + 1
        run, failed = run_id or uuid.uuid4().hex, []
        first = start
        while first <= end:
            last = min(end, first + timedelta(days=length - 1))
            try:
                with self.ledger.step(run, f"{phase} {first}..{last}", first) as step:
                    if not step.done:
                        self.run(stg, dims, updates, positions, date_range(self.spark, first, last), phase, force)
            except Exception as error:  # noqa: BLE001 - collected and raised below
                failed.append((first, last, error))
            first = last + timedelta(days=1)
        if failed:
            spans = ", ".join(f"{a}..{b}: {error}" for a, b, error in failed)
            raise RuntimeError(f"{len(failed)} part(s) of the range failed: {spans}") from failed[0][2]
