from datetime import date

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import frame, rows
from wayside.operators import calendar, keys, latest
from wayside.operators.calendar import date_range


def day(n):
    return date(2024, 1, n)


def test_active_services(town):
    got = rows(calendar.active_services(town.stg["calendar"], town.stg["calendar_dates"], town.dates))
    assert got == sorted([("week", day(d)) for d in (1, 2, 4, 5, 7)] + [("gala", day(6)), ("extra", day(6))])


def test_cancelled_and_special(town):
    stg = town.stg
    assert rows(calendar.cancelled_services(stg["calendar_dates"], town.dates)) == [("both", day(4)), ("week", day(3))]
    special = calendar.special_services(stg["calendar"], stg["calendar_dates"], town.dates)
    assert rows(special) == [("both", day(4)), ("gala", day(6))]


def test_service_days_agree_with_set_operations(town):
    stg = town.stg
    days = calendar.service_days(stg["calendar"], stg["calendar_dates"], town.dates)
    args = (stg["calendar"], stg["calendar_dates"], town.dates)
    assert rows(days.filter("active"), "service_id", "service_date") == rows(calendar.active_services(*args))
    assert rows(days.filter("cancelled"), "service_id", "service_date") == rows(calendar.cancelled_services(*args[1:]))
    assert rows(days.filter("special"), "service_id", "service_date") == rows(calendar.special_services(*args))


def test_scattered_dates(town):
    dates = frame(town.spark, "service_date date", (day(2),), (day(2),), (day(6),))
    got = rows(calendar.active_services(town.stg["calendar"], town.stg["calendar_dates"], dates))
    assert got == [("extra", day(6)), ("gala", day(6)), ("week", day(2))]
    empty = calendar.active_services(town.stg["calendar"], town.stg["calendar_dates"], dates.limit(0))
    assert empty.count() == 0


def test_date_range_is_inclusive(spark):
    assert [r.service_date for r in date_range(spark, "2024-02-28", "2024-03-01").collect()] == [
        date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)]


def test_current_version(town):
    assert keys.current_version(town.dims["feed_version"]).first().versionkey == 7
    none = town.dims["feed_version"].filter("not iscurrent")
    assert none.select(keys.version_key(none).alias("v")).first().v == 0


def test_resolve_key_falls_back_to_zero(town):
    got = keys.resolve_route(town.stg["trips"].select("trip_id", "route_id"), town.dims["route"], town.dims["agency"].filter("agencykey = 1"))
    assert rows(got, "trip_id", "routekey", "agencykey") == [
        ("t1", 11, 1), ("t2", 11, 1), ("t3", 12, 0), ("t4", 12, 0), ("t5", 0, 0)]


def test_orphans_ignore_nulls(spark):
    child, parent = frame(spark, "k string", ("a",), ("b",), (None,)), frame(spark, "k string", ("a",))
    assert rows(keys.orphans(child, parent, "k")) == [("b",)]


@settings(max_examples=8, deadline=None)
@given(st.sets(st.text(max_size=4), min_size=1, max_size=60), st.sets(st.text(max_size=4), max_size=30))
def test_keys_are_dense_and_stable(spark, first, second):
    one = keys.assign_keys(frame(spark, "n string", *[(x,) for x in sorted(first)]), ["n"], "k")
    assert sorted(r.k for r in one.collect()) == list(range(1, len(first) + 1))
    before = {r.n: r.k for r in one.collect()}
    both = keys.extend_keys(frame(spark, "n string", *[(x,) for x in sorted(first | second)]), ["n"], "k", one)
    after = {r.n: r.k for r in both.collect()}
    assert {n: after[n] for n in before} == before
    assert sorted(after.values()) == list(range(1, len(first | second) + 1))


def test_keep_latest_is_deterministic(spark):
    df = frame(spark, "k string, t int, v string", ("a", 10, "x"), ("a", 20, "y"), ("a", 20, "z"), ("b", None, "n"), ("b", 1, "m"))
    expected = [("a", 20, "z"), ("b", 1, "m")]
    assert rows(latest.keep_latest(df, ["k"], ["t"])) == expected
    assert rows(latest.keep_latest(df.orderBy(F.desc("v")).repartition(3), ["k"], ["t"])) == expected


def test_keep_latest_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    plan = latest.keep_latest(df, ["k"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_narrow_moves_the_list_only(spark):
    """A list of local rows has no known size; the table is not moved for it."""
    table = spark.range(100).select((F.col("id") % 10).cast("int").alias("datekey"), "id")
    wanted = spark.createDataFrame([(3,), (5,), (3,)], "datekey int")
    found = keys.narrow(table, "datekey", wanted)
    assert sorted(set(r[0] for r in found.select("datekey").collect())) == [3, 5] and found.count() == 20
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
