"""Live outage alarm: state per poller and a timer that fires when nothing comes."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .streams import ALARM_SECONDS, OUTAGE_WINDOWS

OUTAGE = "poller string, window_start timestamp"


class OutageTimer(StatefulProcessor):
    """Per poller: its first window, the next one to judge, and windows with a success that still matter.

    A window is judged once the watermark has passed its end, by a timer set for that moment; a poller that has gone
    silent is judged all the same. Successes older than the windows looked back on are forgotten, so state is bounded by the
    lateness allowed, not by the age of the stream.
    """

    def __init__(self, length: int, seconds: int):
        self.length, self.step = length, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("windows", "first bigint, next bigint, successes array<bigint>")

    def _read(self) -> tuple[int | None, int | None, list[int]]:
        return self.state.get() if self.state.exists() else (None, None, [])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, upcoming, successes = self._read()
        good = set(successes)
        for frame in rows:
            start = frame["ts"].to_numpy("datetime64[ms]").astype("int64") // self.step * self.step
            polled = (frame["ok"] + frame["fail"]).to_numpy() > 0
            if polled.any():
                earliest = int(start[polled].min())
                first = earliest if first is None or upcoming is None and earliest < first else first
            good.update(start[frame["ok"].to_numpy() > 0].tolist())
        if first is not None:
            self.state.update((first, upcoming, sorted(good)))
            # The first windows have no full history and raise nothing.
            due = first + (self.length - 1) * self.step if upcoming is None else upcoming
            self.handle.registerTimer(due + self.step)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, upcoming, successes = self._read()
        if first is None:
            return
        window = first + (self.length - 1) * self.step if upcoming is None else upcoming
        reached, out, at, last = timerValues.getCurrentWatermarkInMs(), [], 0, None
        while window + self.step <= reached:
            while at < len(successes) and successes[at] <= window:
                last = successes[at]
                at += 1
            if last is None or last <= window - self.length * self.step:
                out.append(window)
            window += self.step
        self.state.update((first, window, [s for s in successes if s > window - self.length * self.step]))
        self.handle.registerTimer(window + self.step)
        if out:
            times = pd.to_datetime(pd.Series(out), unit="ms")
            yield pd.DataFrame({"poller": [key[0]] * len(out), "window_start": times})

    def close(self) -> None:
        pass


POLLS = "poller string, ts timestamp, ok bigint, fail bigint"
#: Windows of pollers that a task adds up before it hands them on.
HELD_WINDOWS = 100_000


def polls_by_window(log: DataFrame, seconds: int = ALARM_SECONDS) -> DataFrame:
    """Polls (poller, ts, ok, fail) added up per poller and window inside each task, at the last time of the window: what the timers and the
    watermark need, at most one row per task, poller and window in a batch. Polls without a time pass as they are."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]).to_pandas(timestamp_as_object=False)
            rows["at"] = rows["ts"].dt.floor(f"{seconds}s")
            rows = rows if held is None else pd.concat([held, rows])
            held = rows.groupby(["poller", "at"], dropna=False, as_index=False).agg({"ts": "max", "ok": "sum", "fail": "sum"})
            if len(held) >= HELD_WINDOWS:
                yield out(held, batch.schema)
                held = None
        if held is not None:
            yield out(held, batch.schema)

    def out(held: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(held[schema.names], schema=schema, preserve_index=False)

    return log.mapInArrow(add_up, POLLS)


def live_outages(log: DataFrame, late: str = "10 minutes", length: int = OUTAGE_WINDOWS, seconds: int = ALARM_SECONDS) -> DataFrame:
    """Outages of each poller as they happen, from a stream of polls (poller, ts, ok, fail; ``ts`` a TIMESTAMP).

    Raises the windows of ``outage_windows``, each once its end is behind the watermark. The watermark only moves with rows of the stream:
    join a heartbeat (``heartbeats``) or other pollers to it, so that silence is noticed. Polls go to the one task of their poller added up per window.
    Needs the RocksDB state store.
    """
    polls = log.select(F.col("poller").cast("string"), "ts", F.col("ok").cast("bigint"), F.col("fail").cast("bigint"))
    marked = polls_by_window(polls, seconds).withWatermark("ts", late)
    return marked.groupBy("poller").transformWithStateInPandas(OutageTimer(length, seconds), OUTAGE, "Append", "EventTime").where("poller <> ''")


def heartbeats(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """Rows of no poller that carry the time, to be joined to a live poll log; they raise nothing."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return clock.select(F.lit("").alias("poller"), F.col("timestamp").alias("ts"), F.lit(0).alias("ok"), F.lit(0).alias("fail"))


def heartbeat_at(spark: SparkSession, at: datetime) -> DataFrame:
    """One heartbeat, for replays and tests."""
    moment = F.timestamp_seconds(F.lit(at.replace(tzinfo=timezone.utc).timestamp()))
    return spark.range(1).select(F.lit("").alias("poller"), moment.alias("ts"), F.lit(0).alias("ok"), F.lit(0).alias("fail"))
