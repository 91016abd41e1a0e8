"""Tables laid out in buckets: a live merge gives the same fact, and neither the fact nor the stored updates move."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayside.operators import stops
from wayside.schemas import FACT_STOP, STOP_UPDATES, conform
from wayside.session import settings
from wayside.sources import sinks
from wayside.streaming import facts, streams

DAY, FED = datetime(2024, 1, 1), datetime(2024, 1, 1, 7, 0)


def reports(town, part: int):
    """Later reports of the same visits, the last part for a day of its own."""
    at = DAY + timedelta(days=part // 2)
    return town.updates(*[("t1", f"s{i}", i, at.date(), at + timedelta(hours=8, minutes=10 * i + part), FED + timedelta(minutes=part)) for i in (1, 2, 3)])


def test_live_stop_merge_in_buckets_equals_batch(spark, town, tmp_path):
    source, fact, table = (str(tmp_path / n) for n in ("updates", "fact", "table"))
    skeleton = stops.stop_skeleton(town.stg, town.dims, town.dates)
    for part in range(3):
        reports(town, part).coalesce(1).write.mode("append").parquet(source)
    stored = facts.stop_fact_by_visit(fact, 3)
    stored.replace(stops.stop_skeleton(town.stg, town.dims, town.dates, parts=3))
    assert rows(sinks.read_table(spark, fact, FACT_STOP)) == rows(skeleton)

    def run(state):
        stream = spark.readStream.schema(conform(reports(town, 0), STOP_UPDATES).schema).option("maxFilesPerTrigger", 1).parquet(source)
        facts.stream_stop_merge(stream, fact, table, town.dims, str(tmp_path / state), buckets=3).awaitTermination()
        return rows(sinks.read_table(spark, fact, FACT_STOP))

    want = rows(conform(stops.stop_official(stops.merge_stop_updates(skeleton, spark.read.parquet(source), town.dims, force=True)), FACT_STOP))
    assert run("state") == want and sum("GTFS_RT_REPORTED" in r for r in want) == 6
    stored.forget(spark)  # as after a restart: the catalog knows nothing, the files are there
    facts.updates_by_trip(table, 3).forget(spark)
    assert run("again") == want
    days = [p for p in Path(fact).iterdir() if p.name.startswith("datekey=")]
    assert days and all(len(list(p.glob("*.parquet"))) <= 3 for p in days)


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_stored_rows_do_not_move(spark, town, tmp_path, monkeypatch, threshold):
    """Of a batch's two plans, the upsert moves the batch alone, and the merge no row of the fact."""
    fact, table = str(tmp_path / "fact"), str(tmp_path / "table")
    stored, laid = facts.stop_fact_by_visit(fact, 3), facts.updates_by_trip(table, 3)
    stored.replace(stops.stop_skeleton(town.stg, town.dims, town.dates, parts=3))
    merge, plans, real = facts.merge_live_updates(fact, table, town.dims, 3), [], sinks.Bucketed.replace

    def watched(self, df):
        with settings(spark, sinks.IN_PLACE):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        real(self, df)

    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": threshold}):
        merge(reports(town, 0), 0)
        monkeypatch.setattr(sinks.Bucketed, "replace", watched)
        merge(reports(town, 1), 1)
    upsert, merged = plans
    assert upsert.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in upsert
    beside = merged.split("LeftOuter")[1].split(f"{stored.name}[")[0]
    assert "Exchange" not in beside and "Sort " not in beside
    assert merged.count("Bucketed: true") >= 1 and sum("GTFS_RT_REPORTED" in r for r in rows(sinks.read_table(spark, fact, FACT_STOP))) == 3


def test_upsert_in_buckets_equals_plain(spark, town, tmp_path):
    """Also with repeats inside a batch, reports without a trip or a day, and replays."""
    newest = [F.col("arrival_time_local").isNotNull().desc(), "feed_timestamp_utc"]
    odd = town.updates((None, "s1", 1, DAY.date(), DAY, FED), ("t1", "s1", 1, None, DAY, FED), ("t2", "s9", 1, DAY.date(), None, FED + timedelta(hours=1)))
    batches = [reports(town, 0).unionByName(reports(town, 1)), odd, reports(town, 2), reports(town, 0), odd]
    found = []
    for name, laid in (("plain", None), ("laid", facts.updates_by_trip(str(tmp_path / "laid"), 3))):
        put = streams.upsert_latest(str(tmp_path / name), facts.UPDATE_KEYS, newest, "service_date", laid)
        for number, batch in enumerate(batches):
            put(conform(batch, STOP_UPDATES), number)
        found.append(rows(sinks.read_table(spark, str(tmp_path / name), STOP_UPDATES)))
    assert found[0] == found[1] and len(found[0]) == 9
