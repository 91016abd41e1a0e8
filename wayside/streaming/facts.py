"""Facts that follow the stream: pings merged into scheduled trips as they come."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import date_key
from ..operators.keys import narrow
from ..operators.stops import VISIT, merge_stop_updates, stop_official
from ..operators.trips import merge_summary, ping_summary
from ..schemas import FACT_STOP, FACT_TRIP, STOP_UPDATES
from ..sources.sinks import Bucketed, read_table, replace_partition
from .streams import upsert_latest

# What identifies a reported stop visit.
UPDATE_KEYS = ["agency_key", "trip_id", "stop_id", "stop_sequence", "service_date"]

PART = "trip_id string, first_ping timestamp_ntz, last_ping timestamp_ntz, ping_count int, service_date date, batch bigint"


def merge_live_pings(fact: str, parts: str, dims: Mapping[str, DataFrame], estimated_scope: bool = True, cutoff_hour: int = 0):
    """``foreachBatch`` function that merges each batch of pings into the stored trip fact at ``fact``.

    A batch first leaves its own summary (first and last ping and count per trip and service day) at ``parts``, laid out by day and batch. The
    summaries of the days it touches are then added up and joined with the scheduled trips of those days, and these date
    partitions are replaced. So a batch costs what its days hold, whatever the length of the stream, and one that is replayed overwrites its own
    summary and gives the same fact. Operated trips are re-evaluated as pings come in; cancelled ones never change: the result is that of
    ``merge_pings(force=True)`` over all pings so far.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine = ping_summary(batch, cutoff_hour=cutoff_hour).withColumn("batch", F.lit(number).cast("bigint"))
        replace_partition(mine, parts, "service_date", "batch")
        stored = read_table(spark, parts, PART)
        days = [r[0] for r in stored.filter(F.col("batch") == number).select("service_date").distinct().collect()]
        if not days:
            return
        summary = stored.filter(F.col("service_date").isin(days)).groupBy("trip_id", "service_date").agg(
            F.min("first_ping").alias("first_ping"), F.max("last_ping").alias("last_ping"), F.sum("ping_count").cast("int").alias("ping_count")
        )
        wanted = spark.createDataFrame([(d,) for d in days], "service_date date").select(date_key("service_date").alias("datekey"))
        rows = narrow(read_table(spark, fact, FACT_TRIP), "datekey", wanted)
        replace_partition(merge_summary(rows, summary, dims, True, estimated_scope), fact, "datekey")

    return merge


def stream_trip_merge(positions: DataFrame, fact: str, parts: str, dims: Mapping[str, DataFrame], checkpoint: str, available_now: bool = True, **options):
    """Start merging a stream of pings into the trip fact."""
    writer = positions.writeStream.foreachBatch(merge_live_pings(fact, parts, dims, **options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stop_fact_by_visit(path: str, buckets: int) -> Bucketed:
    """A stop fact at ``path`` whose days are laid out in buckets of visits."""
    return Bucketed(path, FACT_STOP, "datekey", tuple(VISIT), buckets)


def updates_by_trip(path: str, buckets: int) -> Bucketed:
    """Newest updates at ``path`` whose days are laid out in buckets of trips, as ``stop_fact_by_visit`` is in those of visits."""
    return Bucketed(path, STOP_UPDATES, "service_date", ("trip_id",), buckets)


def merge_live_updates(fact: str, updates: str, dims: Mapping[str, DataFrame], buckets: int | None = None):
    """``foreachBatch`` function that merges each batch of stop updates into the stored stop fact at ``fact``.

    The newest update of each visit that has an arrival is kept at ``updates``, by service day; the visits of the days a batch touches are then merged anew and their
    date partitions replaced. A replayed batch finds its own updates there and changes nothing. The result is that of
    ``merge_stop_updates(force=True)`` with all updates so far.

    Where the fact is laid out in ``buckets`` (``stop_fact_by_visit``), so are the updates, and neither moves: a batch moves to the stored updates, and what
    is newest of them to the fact. Otherwise the rows of these days move twice, to their updates and back to their days.
    """
    # A report without an arrival does not hide an earlier one that has it.
    newest = [F.col("arrival_time_local").isNotNull().desc(), "feed_timestamp_utc"]
    laid = None if buckets is None else updates_by_trip(updates, buckets)
    keep = upsert_latest(updates, UPDATE_KEYS, newest, "service_date", laid)

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keep(batch, number)
        days = [r[0] for r in batch.select("service_date").distinct().collect() if r[0]]
        if not days:
            return
        if laid is not None:
            stored = stop_fact_by_visit(fact, buckets)
            rows = stored.rows(spark).filter(F.col("datekey").isin([int(f"{d:%Y%m%d}") for d in days]))
            reported = laid.rows(spark).filter(F.col("service_date").isin(days))
            stored.replace(stop_official(merge_stop_updates(rows, reported, dims, True, buckets)))
            return
        wanted = spark.createDataFrame([(d,) for d in days], "service_date date")
        reported = narrow(read_table(spark, updates, STOP_UPDATES), "service_date", wanted)
        rows = narrow(read_table(spark, fact, FACT_STOP), "datekey", wanted.select(date_key("service_date").alias("datekey")))
        replace_partition(stop_official(merge_stop_updates(rows, reported, dims, True)), fact, "datekey")

    return merge


def stream_stop_merge(updates: DataFrame, fact: str, table: str, dims: Mapping[str, DataFrame], checkpoint: str, available_now: bool = True, buckets: int | None = None):
    """Start merging a stream of stop updates into the stop fact."""
    writer = updates.writeStream.foreachBatch(merge_live_updates(fact, table, dims, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
