"""Continuous ingest, running summaries and feed alarms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import DEFAULT_ZONE, epoch_second, utc_time
from ..functions.guards import non_blank
from ..operators.flatten import flatten_trip_updates, flatten_vehicle_positions, valid_snapshots
from ..operators.latest import keep_latest
from ..schemas import FEED_BODY
from ..sources.feeds import feed_glob, with_path_parts
from ..sources.sinks import Bucketed, replace_partition
from ..sources.static import path_exists

# Alarm period and windows without success that make an outage.
ALARM_SECONDS = 300
OUTAGE_WINDOWS = 5


def stream_feed(spark: SparkSession, root: str, agency: str = "*", feed: str = "*", fmt: str = "json",
                files_per_trigger: int | None = None) -> DataFrame:
    """Snapshots as they land; junk is dropped."""
    reader = spark.readStream.schema(FEED_BODY).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return valid_snapshots(with_path_parts(reader.load(feed_glob(root, agency, feed))))


def stream_trip_updates(spark: SparkSession, root: str, zone: str = DEFAULT_ZONE, **options) -> DataFrame:
    return flatten_trip_updates(stream_feed(spark, root, feed="trip-updates", **options), zone)


def stream_vehicle_positions(spark: SparkSession, root: str, zone: str = DEFAULT_ZONE, **options) -> DataFrame:
    return flatten_vehicle_positions(stream_feed(spark, root, feed="vehicle-positions", **options), zone)


def upsert_latest(path: str, keys: Sequence[str], newest: Sequence[str], partition: str, table: Bucketed | None = None):
    """``foreachBatch`` function that keeps the newest row per key in a partitioned table.

    Only the partitions a batch touches, a short list of days, are read and replaced, so its cost follows the batch,
    not the table. The batch and what is stored move once, together. Replaying a batch leaves the table as it was.
    With ``table``, a bucketed table at ``path`` whose keys are among ``keys``, the batch moves to its buckets and what is stored does not move.
    """
    def write(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        incoming = batch.persist()
        if not incoming.isEmpty():
            rows = incoming
            if table is not None:
                rows = incoming.repartition(table.buckets, *table.keys)
            if path_exists(spark, path):
                stored = spark.read.schema(incoming.schema).parquet(path) if table is None else table.rows(spark)
                days = [row[0] for row in incoming.select(partition).distinct().collect()]
                stored = stored.select(*incoming.columns).filter(F.col(partition).isin(days))
                rows = rows.unionByName(stored)  # in this order Spark sees that a bucketed table's rows need not move
            latest = keep_latest(rows, keys, newest)
            table.replace(latest) if table is not None else replace_partition(latest, path, partition)
        incoming.unpersist()

    return write


def stream_latest(df: DataFrame, path: str, keys: Sequence[str], newest: Sequence[str], partition: str, checkpoint: str,
                  available_now: bool = True):
    """Start keeping the newest row per key of a stream in ``path``."""
    writer = df.writeStream.foreachBatch(upsert_latest(path, keys, newest, partition)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def without_repeats(rows: DataFrame, keys: Sequence[str], at: str, late: str = "2 hours") -> DataFrame:
    """A stream with rows of the same ``keys`` once, as long as they come within ``late`` of each other.

    ``at`` is a wall-clock column; shifted to a TIMESTAMP it carries the watermark, which bounds the keys held as state. A poll that is
    sent again, or a file that is delivered twice, adds nothing downstream. Rows without a time cannot be placed and drop out.
    """
    clock = F.timestamp_seconds(epoch_second(at))
    marked = rows.filter(F.col(at).isNotNull()).withColumn("_at", clock).withWatermark("_at", late)
    return marked.dropDuplicatesWithinWatermark(list(keys)).drop("_at")


def stream_ping_summary(positions: DataFrame, late: str = "2 hours", keys: Sequence[str] = ("trip_id",)) -> DataFrame:
    """Running first ping, last ping and count per trip and local service day.

    The local wall clock serves as event time (shifted to a TIMESTAMP so it can carry the
    watermark); ``late`` must exceed the hour that repeats in autumn. State holds one entry per
    trip-day and goes once its day is behind the watermark.
    """
    clock = F.timestamp_seconds(epoch_second("timestamp_local"))
    pings = positions.filter(non_blank("trip_id") & F.col("timestamp_local").isNotNull())
    marked = pings.select(*keys, clock.alias("_at")).withWatermark("_at", late)
    summary = marked.groupBy(*keys, F.window("_at", "1 day").alias("_day")).agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).cast("int").alias("ping_count")
    )
    return summary.select(
        *keys,
        utc_time(F.unix_seconds("_day.start")).cast("date").alias("service_date"),
        utc_time(F.unix_seconds("_first")).alias("first_ping"),
        utc_time(F.unix_seconds("_last")).alias("last_ping"),
        "ping_count",
    )


def poll_windows(log: DataFrame) -> DataFrame:
    """Successes and failures per tumbling window of a poll log (ts, ok, fail); batch or stream."""
    return log.groupBy(F.window("ts", f"{ALARM_SECONDS} seconds").alias("_w")).agg(
        F.sum("ok").alias("ok"), F.sum("fail").alias("fail")
    ).select(F.col("_w.start").alias("window_start"), "ok", "fail")


def failure_windows(log: DataFrame, threshold: int = 1) -> DataFrame:
    """Windows with at least ``threshold`` failed polls."""
    return poll_windows(log).filter(F.col("fail") >= threshold)


def stream_failure_windows(log: DataFrame, late: str = "10 minutes", threshold: int = 1) -> DataFrame:
    """Streaming twin of ``failure_windows``; ``ts`` must be a TIMESTAMP."""
    return failure_windows(log.withWatermark("ts", late), threshold)


def outage_windows(windows: DataFrame, length: int = OUTAGE_WINDOWS, as_of: Column | None = None) -> DataFrame:
    """Windows that end ``length`` windows in a row without success; a window with no poll counts.

    Windows are looked at up to the last one complete at ``as_of`` (a timestamp), or up to the last poll without it, which
    misses an outage that has not ended.

    A window is clear if one of the ``length`` windows up to it succeeded. Every success therefore
    clears the windows from its own to ``length - 1`` later; those not cleared are outages. This
    is two equi-joins on the window start instead of an ordered pass over all time. The first
    ``length - 1`` windows of the log have no full history and raise nothing.
    """
    step = F.expr(f"interval {ALARM_SECONDS} seconds")
    bounds = windows.agg(F.min("window_start").alias("_from"), F.max("window_start").alias("_to"))
    if as_of is not None:
        complete = f"(timestampdiff(SECOND, _from, _as_of) div {ALARM_SECONDS} - 1) * {ALARM_SECONDS}"
        last = F.expr(f"_from + make_dt_interval(0, 0, 0, {complete})")
        bounds = bounds.withColumn("_as_of", as_of).withColumn("_to", F.greatest("_to", last))
    spine = bounds.select(F.explode(F.sequence("_from", "_to", step)).alias("window_start"), "_from")
    history = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit((length - 1) * ALARM_SECONDS))
    spine = spine.filter(F.col("window_start") >= F.col("_from") + history).select("window_start")
    cleared = windows.filter("ok >= 1").select(
        F.explode(F.sequence("window_start", F.col("window_start") + history, step)).alias("window_start")
    )
    return spine.join(cleared.distinct(), "window_start", "left_anti")
