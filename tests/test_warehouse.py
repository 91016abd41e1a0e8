"""Stored feed days, dimensions and the run ledger."""

import json
from datetime import date, datetime, timedelta, timezone

import pytest

from conftest import frame, rows
from test_sources import snapshot
from wayside.operators import audit
from wayside.operators.history import known_keys, merge_history, valid_on
from wayside.plans import daily, ledger
from wayside.plans.dimstore import DimensionStore
from wayside.plans.ledger import Ledger


def ping(at: datetime, vehicle: str = "v") -> dict:
    second = int(at.replace(tzinfo=timezone.utc).timestamp())
    return {"vehicle": {"trip": {"trip_id": "t1"}, "vehicle": {"id": vehicle}, "position": {"latitude": 1.0, "longitude": 2.0}, "timestamp": second}}


def land_pings(root, day: str, *moments: datetime) -> None:
    folder = root / "north" / "vehicle-positions" / day.replace("-", "/")
    folder.mkdir(parents=True, exist_ok=True)
    for number, at in enumerate(moments):
        (folder / f"{number:06d}.json").write_text(json.dumps(snapshot(int(at.replace(tzinfo=timezone.utc).timestamp()), ping(at))))


def per_day(house) -> list:
    return sorted((r["service_date"], r["count"]) for r in house.positions().groupBy("service_date").count().collect())


def test_a_feed_day_keeps_its_neighbours(spark, tmp_path):
    root, house = tmp_path / "feeds", daily.Warehouse(spark, str(tmp_path / "house"), daily.Options(cutoff_hour=3))
    first, second = date(2026, 4, 1), date(2026, 4, 2)
    noon = datetime(2026, 4, 1, 12)
    land_pings(root, "2026-04-01", *[noon + timedelta(minutes=m) for m in range(20)])
    land_pings(root, "2026-04-02", datetime(2026, 4, 1, 23, 59, 50), datetime(2026, 4, 2, 1, 0), noon + timedelta(minutes=3), datetime(2026, 4, 2, 9, 0))
    done = house.load_feed_day(str(root), first, {}, zone="UTC")
    assert done["rt_vehicle_positions"] and not done["rt_stop_time_updates"]
    counts = done["rt_vehicle_positions"]
    assert (counts.read, counts.kept, counts.written, counts.days) == (20, 20, 20, (first,))
    counts = house.load_feed_day(str(root), second, {}, zone="UTC")["rt_vehicle_positions"]
    # One ping of the second landing repeats one of the first; two more belong to the day before.
    assert (counts.read, counts.kept, counts.written, counts.days) == (4, 4, 23, (first, second))
    assert per_day(house) == [(first, 22), (second, 1)]
    for day in (first, second):  # loading either again changes nothing
        house.load_feed_day(str(root), day, {}, zone="UTC")
        assert per_day(house) == [(first, 22), (second, 1)]
    entry = house.ledger.entries().filter("step = 'vehicle-positions' and run_date = date'2026-04-02'").first()
    assert (entry.status, entry.rows_read, entry.rows_written) == ("SUCCEEDED", 4, 23)


def test_a_corrected_landing_takes_the_place_of_its_own_rows(spark, tmp_path):
    root, again, house = tmp_path / "feeds", tmp_path / "again", daily.Warehouse(spark, str(tmp_path / "house"))
    land_pings(root, "2026-04-02", datetime(2026, 4, 1, 23, 59), datetime(2026, 4, 2, 9, 0), datetime(2026, 4, 2, 10, 0))
    land_pings(again, "2026-04-02", datetime(2026, 4, 2, 9, 0))
    house.load_feed_day(str(root), date(2026, 4, 2), {}, zone="UTC")
    house.load_feed_day(str(again), date(2026, 4, 2), {}, zone="UTC")
    assert per_day(house) == [(date(2026, 4, 2), 1)]


DIM = "stopkey bigint, stopid string, stopname string, versionkey int"


def test_history(spark):
    day = lambda n: date(2024, 1, n)
    history = frame(spark, f"{DIM}, validfrom date, validto date", (9, "z", "old", 1, day(1), day(2)))
    def load(history, n, *stops):
        known = {r.stopid: r.stopkey for r in known_keys(history, ["stopid"], "stopkey").collect()}
        fresh = frame(spark, DIM, *[(known.get(s, 100 + n), s, name, n) for s, name in stops])
        return spark.createDataFrame(merge_history(history, fresh, ["stopid"], "stopkey", day(n)).collect(), history.schema)

    one = load(history, 3, ("a", "A"), ("b", "B"), ("c", None))
    two = load(one, 5, ("a", "A"), ("b", "B2"), ("c", None), ("z", "back"))
    three = load(two, 7, ("b", "B2"), ("c", None), ("z", "back"))
    expected = [
        ("a", "A", 3, day(3), day(7)), ("b", "B", 3, day(3), day(5)), ("b", "B2", 5, day(5), None), ("c", None, 3, day(3), None),
        ("z", "back", 5, day(5), None), ("z", "old", 1, day(1), day(2)),
    ]
    names = ["stopid", "stopname", "versionkey", "validfrom", "validto"]
    assert rows(three, *names) == sorted(expected, key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert {r.stopkey for r in three.filter("stopid = 'z'").collect()} == {9}
    assert rows(load(three, 7, ("b", "B2"), ("c", None), ("z", "back"))) == rows(three)
    twice = load(load(one, 5, ("a", "wrong")), 5, ("a", "A2"))  # a second load on the same day
    assert rows(twice.filter("stopid = 'a'"), "stopname", "validfrom", "validto") == [("A", day(3), day(5)), ("A2", day(5), None)]
    assert rows(valid_on(three, day(6)), "stopid", "stopname") == [("a", "A"), ("b", "B2"), ("c", None), ("z", "back")]
    assert rows(valid_on(three, day(4)), "stopid") == [("a",), ("b",), ("c",)]


def test_dimension_loads_take_effect_as_a_whole(town, tmp_path):
    store = DimensionStore(town.spark, str(tmp_path / "dims"))
    feed = lambda h, d: frame(town.spark, "feedhash string, ingestedat timestamp_ntz", (h, datetime(2024, 1, d)))
    store.load(town.stg, date(2024, 1, 1), feed("aa", 1))
    before = store.generation()
    broken = {k: v for k, v in town.stg.items() if k != "transfers"}
    with pytest.raises(KeyError):
        store.load(broken, date(2024, 1, 9), feed("bb", 9))
    assert store.generation() == before and rows(store.versions(), "feedhash") == [("aa",)]
    keys = {r.tripid: r.tripkey for r in store.current()["trip"].collect()}
    fewer = {**town.stg, "trips": town.stg["trips"].filter("trip_id <> 't2'")}
    store.load(fewer, date(2024, 1, 9), feed("bb", 9))
    store.load(town.stg, date(2024, 1, 20), feed("cc", 20))
    assert {r.tripid: r.tripkey for r in store.current()["trip"].collect()} == keys
    assert "t2" in {r.tripid for r in store.as_of(date(2024, 1, 8))["trip"].collect()}
    assert "t2" not in {r.tripid for r in store.as_of(date(2024, 1, 10))["trip"].collect()}
    assert len(store.drop_old(1)) == 3 and store.current()["trip"].count() == len(keys)


def test_ledger(spark, tmp_path):
    book, day = Ledger(spark, str(tmp_path / "ledger")), date(2024, 1, 1)
    with pytest.raises(ValueError), book.step("r1", "timetable", day) as step:
        step.note(is_new_version=True, file_count=9, feed_key="main", feed_hash="aa")
        raise ValueError("no disk")
    assert rows(ledger.runs(book.entries()), "run_date", "status", "error") == [(day, "FAILED", "ValueError: no disk")]
    ran = []
    for _ in range(2):
        with book.step("r1", "timetable", day) as step:
            if not step.done:
                ran.append(1)
                step.note(is_new_version=True, file_count=9, feed_key="main", feed_hash="aa", rows_written=7)
    assert ran == [1] and book.attempts().count() == 2
    assert rows(book.entries(), "run_id", "step", "status", "rows_written", "error") == [("r1", "timetable", "SUCCEEDED", 7, None)]
    none = frame(spark, "run_date date, fallback_date date")
    checks = frame(spark, "run_date date, overall_passed boolean, passed int, total_tables int", (day, True, 9, 9))
    digest = audit.daily_digest(ledger.runs(book.entries()), checks, none, ledger.versions_seen(book.entries()), book.entries().select("run_date")).first()
    assert (digest.headline, digest.feed_hash, digest.is_new_version, digest.file_count) == ("OK", "aa", True, 9)
    last = audit.latest_manifest(ledger.manifests(book.entries()), "2024-01-02").first()
    assert (last.feed_key, last.feed_hash, last.fallback_date) == ("main", "aa", day)


def test_range_resumes(town, tmp_path):
    house = daily.Warehouse(town.spark, str(tmp_path))
    none = town.updates(("t1", "s1", 1, date(2024, 1, 1), datetime(2024, 1, 1, 8), datetime(2024, 1, 1, 9))), town.pings(("t1", datetime(2024, 1, 1, 8)))
    span = (date(2024, 1, 1), date(2024, 1, 2))
    broken = {**town.dims, "trip": town.dims["trip"].limit(0)}
    with house.ledger.step("run", f"skeleton {span[0]}..{span[0]}", span[0]):
        pass
    with pytest.raises(RuntimeError, match="1 part"):
        house.run_range(town.stg, broken, *none, *span, phase="skeleton", days_per_job=1, run_id="run")
    house.run_range(town.stg, town.dims, *none, *span, phase="skeleton", days_per_job=1, run_id="run")
    assert {r.datekey for r in house.stop().collect()} == {20240102}
    status = {r.step: r.status for r in house.ledger.entries().collect()}
    assert len(status) == 2 and set(status.values()) == {"SUCCEEDED"}
