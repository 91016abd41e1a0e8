from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import frame, rows
from test_sources import land, snapshot, trip_update
from wayside.operators import flatten, latest, stops, trips
from wayside.schemas import FACT_STOP, FACT_TRIP, conform
from wayside.sources import feeds, sinks
from wayside.streaming import alarms, facts, streams

KEYS = ["agency_key", "trip_id", "stop_id", "stop_sequence", "service_date"]


def test_stream_of_snapshots_equals_batch(spark, tmp_path):
    root, table = tmp_path / "feeds", str(tmp_path / "table")
    ts = 1_704_182_400
    def one(minute, trip, seq, delay):
        body = {"stop_id": f"s{seq}", "stop_sequence": seq, "arrival": {"time": ts + minute * 60 + delay, "delay": delay}}
        land(root, "north", "trip-updates", f"2024/01/02/08{minute:02d}00", snapshot(ts + minute * 60, trip_update(trip, body)))

    for minute in range(6):
        one(minute, "t1", minute % 2, minute * 10)
    def load(checkpoint):
        updates = streams.stream_trip_updates(spark, str(root), files_per_trigger=2)
        streams.stream_latest(updates, table, KEYS, ["feed_timestamp_utc"], "service_date", checkpoint).awaitTermination()

    checkpoint = str(tmp_path / "state")
    load(checkpoint)
    batch = latest.keep_latest(flatten.flatten_trip_updates(flatten.valid_snapshots(feeds.read_feed(spark, str(root)))), KEYS, ["feed_timestamp_utc"])
    columns = batch.columns
    assert rows(spark.read.parquet(table), *columns) == rows(batch) and batch.count() == 2
    one(9, "t2", 1, 5)
    load(checkpoint)  # resumes after the files it has seen
    assert spark.read.parquet(table).count() == 3
    load(str(tmp_path / "fresh-state"))  # replaying everything leaves the table as it was
    assert rows(spark.read.parquet(table), "trip_id", "stop_id", "arrival_delay") == [("t1", "s0", 40), ("t1", "s1", 50), ("t2", "s1", 5)]


def test_running_ping_summary_equals_batch(spark, town, tmp_path):
    source, table = str(tmp_path / "pings"), str(tmp_path / "summary")
    base = datetime(2024, 1, 1, 22, 0)
    for part in range(3):
        chunk = [(f"t{i % 2}", base + timedelta(minutes=17 * i + part)) for i in range(12)] + [("", base)]
        town.pings(*chunk).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = streams.stream_ping_summary(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    write = streams.upsert_latest(table, ["trip_id", "service_date"], ["ping_count"], "service_date")
    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    columns = ["trip_id", "service_date", "first_ping", "last_ping", "ping_count"]
    expected = trips.ping_summary(spark.read.parquet(source))
    assert rows(spark.read.parquet(table), *columns) == rows(expected, *columns) and expected.count() == 4


def polls(spark, *entries):
    return frame(spark, "ts timestamp_ntz, ok int, fail int", *[(datetime(2024, 1, 1, 0, m), ok, bad) for m, ok, bad in entries])


def test_failure_windows(spark):
    log = polls(spark, (0, 4, 0), (4, 3, 1), (7, 4, 0), (11, 2, 2), (13, 3, 1))
    got = rows(streams.failure_windows(log), "window_start", "fail")
    assert got == [(datetime(2024, 1, 1, 0, 0), 1), (datetime(2024, 1, 1, 0, 10), 3)]


def test_outage_counts_missing_windows(spark):
    log = polls(spark, (0, 4, 0), (32, 0, 4), (41, 4, 0), (58, 0, 4))
    got = [r.window_start.minute for r in streams.outage_windows(streams.poll_windows(log)).orderBy("window_start").collect()]
    # windows 5..25 make the first five in a row without success; 40 clears up to 55
    assert got == [25, 30, 35]


def test_outage_after_the_last_poll(spark):
    windows = streams.poll_windows(polls(spark, (0, 4, 0), (5, 4, 0), (10, 4, 0)))
    starts = lambda **k: [r.window_start.minute for r in streams.outage_windows(windows, **k).orderBy("window_start").collect()]
    assert starts() == []
    assert starts(as_of=F.lit(datetime(2024, 1, 1, 0, 50)).cast("timestamp_ntz")) == [35, 40, 45]


def test_streaming_failures_equal_batch(spark, tmp_path):
    source = str(tmp_path / "log")
    log = polls(spark, (0, 4, 0), (4, 3, 1), (11, 2, 2)).withColumn("ts", F.col("ts").cast("timestamp"))
    log.write.parquet(source)
    stream = streams.stream_failure_windows(spark.readStream.schema(log.schema).parquet(source))
    query = stream.writeStream.outputMode("update").format("memory").queryName("failures").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("failures")) == rows(streams.failure_windows(log))


def test_live_outages_equal_batch(spark, tmp_path):
    landed, out = str(tmp_path / "log"), str(tmp_path / "out")
    minutes = {"a": [(0, 4, 0), (32, 0, 4), (41, 4, 0), (58, 0, 4)], "b": [(0, 1, 0), (5, 1, 0), (10, 1, 0)], "c": [(50, 0, 1)]}
    log = frame(spark, "poller string, ts timestamp, ok int, fail int", *[(p, datetime(2024, 1, 1, 0, m), ok, bad) for p, e in minutes.items() for m, ok, bad in e])
    log.repartition(3).write.parquet(landed)
    as_of = datetime(2024, 1, 1, 2, 2)
    alarms.heartbeat_at(spark, as_of + timedelta(minutes=10)).write.mode("append").parquet(landed)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = alarms.live_outages(spark.readStream.schema(log.schema).parquet(landed))
        def load():
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()

        load()
        raised = rows(spark.read.parquet(out))
        expected = []
        for poller in minutes:
            mine = log.filter(F.col("poller") == poller).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
            batch = streams.outage_windows(streams.poll_windows(mine), as_of=F.lit(as_of).cast("timestamp_ntz"))
            expected += [(poller, r.window_start) for r in batch.collect()]
        assert raised == sorted(expected) and {p for p, _ in raised} == {"a", "b", "c"}
        # Restarted, with only a heartbeat and a success after it: b goes on from its state.
        frame(spark, "poller string, ts timestamp, ok int, fail int", ("b", datetime(2024, 1, 1, 2, 20), 1, 0), ("", datetime(2024, 1, 1, 2, 55), 0, 0)).write.mode("append").parquet(landed)
        load()
        late = [w.minute + 60 * w.hour for p, w in rows(spark.read.parquet(out)) if p == "b"]
        assert late == [*range(35, 140, 5)]  # quiet from 0:15 on, cleared by the success at 2:20 for five windows
    finally:
        spark.conf.set(store, before)


def test_polls_are_added_up_before_they_move(spark):
    base = datetime(2024, 1, 1)
    polls = frame(spark, "poller string, ts timestamp, ok bigint, fail bigint", *[(p, base + timedelta(seconds=s), s % 2, 1 - s % 2) for p in "ab" for s in range(900)]).coalesce(1)
    got = rows(alarms.polls_by_window(polls))
    assert got == [(p, base + timedelta(seconds=w + 299), 150, 150) for p in "ab" for w in (0, 300, 600)]


def test_repeats_within_the_watermark(spark, town, tmp_path):
    source, out = str(tmp_path / "pings"), str(tmp_path / "out")
    base = datetime(2024, 1, 1, 8, 0)
    pings = town.pings(("t1", base), ("t1", base), ("t1", base + timedelta(minutes=1)), ("t2", base))
    for _ in range(2):
        pings.write.mode("append").parquet(source)
    stream = streams.without_repeats(spark.readStream.schema(pings.schema).option("maxFilesPerTrigger", 1).parquet(source), ["trip_id", "timestamp_local"], "timestamp_local")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    assert rows(spark.read.schema(stream.schema).parquet(out), "trip_id", "timestamp_local") == [("t1", base), ("t1", base + timedelta(minutes=1)), ("t2", base)]


def test_live_merge_equals_batch_and_survives_replays(spark, town, tmp_path):
    source, fact, parts = (str(tmp_path / n) for n in ("pings", "fact", "parts"))
    skeleton = trips.trip_skeleton(town.stg, town.dims, town.dates)
    base = datetime(2024, 1, 1, 8, 0)
    for part in range(3):
        town.pings(*[(f"t{1 + i % 2}", base + timedelta(hours=9 * i, minutes=part)) for i in range(6)]).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    sinks.replace_partition(skeleton, fact, "datekey")
    def run(state):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        facts.stream_trip_merge(stream, fact, parts, town.dims, str(tmp_path / state)).awaitTermination()
        return rows(sinks.read_table(spark, fact, FACT_TRIP))

    want = rows(trips.merge_pings(skeleton, spark.read.parquet(source), town.dims, force=True))
    assert run("state") == want and any("OPERATED" in r for r in want)
    assert run("again") == want  # the same batches once more, under the same numbers


def test_live_stop_merge_equals_batch(spark, town, tmp_path):
    source, fact, table = (str(tmp_path / n) for n in ("updates", "fact", "table"))
    day, fed = datetime(2024, 1, 1), datetime(2024, 1, 1, 7, 0)
    skeleton = stops.stop_skeleton(town.stg, town.dims, town.dates)
    for part in range(3):  # later reports of the same visits, then a day of its own
        at = day + timedelta(days=part // 2)
        town.updates(*[("t1", f"s{i}", i, at.date(), at + timedelta(hours=8, minutes=10 * i + part), fed + timedelta(minutes=part)) for i in (1, 2, 3)]).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    sinks.replace_partition(skeleton, fact, "datekey")
    def run(state):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        facts.stream_stop_merge(stream, fact, table, town.dims, str(tmp_path / state)).awaitTermination()
        return rows(sinks.read_table(spark, fact, FACT_STOP))

    want = rows(conform(stops.stop_official(stops.merge_stop_updates(skeleton, spark.read.parquet(source), town.dims, force=True)), FACT_STOP))
    assert run("state") == want and sum("GTFS_RT_REPORTED" in r for r in want) == 6
    assert run("again") == want


def test_upsert_moves_stored_rows_and_batch_once(spark, tmp_path, monkeypatch):
    """Repeats inside a batch and across batches leave the newest row; one window handles both."""
    ranked = []
    monkeypatch.setattr(streams, "keep_latest", lambda df, *a: ranked.append(1) or latest.keep_latest(df, *a))
    put = streams.upsert_latest(str(tmp_path / "t"), ["k"], ["at"], "day")
    for number, batch in enumerate(([("a", 1), ("a", 2), ("b", 5)], [("a", 4), ("a", 3), ("b", 1)])):
        put(spark.createDataFrame([(k, at, "d") for k, at in batch], "k string, at int, day string"), number)
    assert rows(spark.read.parquet(str(tmp_path / "t")), "k", "at") == [("a", 4), ("b", 5)]
    assert len(ranked) == 2
