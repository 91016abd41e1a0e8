"""Transit tables seen through the bundled order and event tables.

The timetable lens reads orders as trips, their lines as stop visits, customers as services with a
calendar in January 2024, suppliers as stops and nations as routes; events are vehicle pings. The
order lens reads each order as one trip run on its order date. Some rows are malformed or
unresolvable on purpose.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flags
from ..functions.clock import date_key
from ..operators.calendar import WEEKDAYS, date_range
from ..operators.dims import describe_dates, dim_time
from ..operators.stops import mark_ends
from ..schemas import DIMENSIONS, FACT_SERVICE_DAY, FACT_STOP, FACT_TRIP, STAGING_COLUMNS, STOP_UPDATES, VEHICLE_POSITIONS, conform
from ..sources.static import reconcile

FIRST_DAY, LAST_DAY = "2024-01-01", "2024-01-30"
AS_OF = "2024-01-30"


def text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def prefixed(prefix: str, value: Column | str) -> Column:
    return F.concat(F.lit(prefix), text(value))


def day_plus(days: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), days.cast("int"))


def yyyymmdd(date: Column) -> Column:
    return date_key(date).cast("string")


def clock_text(hour: Column, minute: Column, second: Column) -> Column:
    """HH:MM:SS text."""
    return F.concat_ws(":", *[F.lpad(text(part), 2, "0") for part in (hour, minute, second)])


def plus_seconds(date: Column, seconds: Column) -> Column:
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


class Frames(Mapping):
    """Frames by name, each built when first asked for."""

    def __init__(self, build: Callable[[str], DataFrame], names: Iterable[str]):
        self._build, self._names, self._built = build, tuple(names), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def __iter__(self):
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


class Lens:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str, **tables: DataFrame):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables = dict(tables)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    # ---- timetable lens: staged tables (all text)

    def _staged(self, name: str, df: DataFrame) -> DataFrame:
        return reconcile(df, STAGING_COLUMNS[name])

    @cached_property
    def dates(self) -> DataFrame:
        return date_range(self.spark, FIRST_DAY, LAST_DAY)

    @cached_property
    def agency(self) -> DataFrame:
        return self._staged("agency", self.table("region").select(
            text("r_regionkey").alias("agency_id"),
            F.col("r_name").alias("agency_name"),
            prefixed("http://agency.example/", "r_regionkey").alias("agency_url"),
            F.lit("America/Los_Angeles").alias("agency_timezone"),
        ))

    @cached_property
    def routes(self) -> DataFrame:
        return self._staged("routes", self.table("nation").select(
            prefixed("R", "n_nationkey").alias("route_id"),
            text("n_regionkey").alias("agency_id"),
            F.col("n_name").alias("route_short_name"),
            prefixed("Line ", "n_name").alias("route_long_name"),
            text(F.col("n_nationkey") % 4).alias("route_type"),
        ))

    @cached_property
    def stops(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self._staged("stops", self.table("supplier").select(
            prefixed("S", key).alias("stop_id"),
            F.col("s_name").alias("stop_name"),
            F.concat(text(key % 90), F.lit(".5")).alias("stop_lat"),
            F.concat(F.lit("-"), text(key % 180), F.lit(".25")).alias("stop_lon"),
            text(F.col("s_nationkey") % 5).alias("location_type"),
        ))

    @cached_property
    def trips(self) -> DataFrame:
        riders = self.table("customer").select("c_custkey", "c_nationkey")
        joined = self.table("orders").join(riders, F.col("o_custkey") == F.col("c_custkey"))
        return self._staged("trips", joined.select(
            text("o_orderkey").alias("trip_id"),
            prefixed("R", "c_nationkey").alias("route_id"),
            prefixed("C", "o_custkey").alias("service_id"),
            F.col("o_orderpriority").alias("trip_headsign"),
            text(F.col("o_orderkey") % 2).alias("direction_id"),
            prefixed("P", "o_custkey").alias("shape_id"),
        ))

    @cached_property
    def stop_times(self) -> DataFrame:
        hour, minute = 20 + F.col("l_linenumber"), F.col("l_quantity").cast("int")
        second = (F.col("l_partkey") % 60).cast("int")
        blank = (F.col("l_discount") == 0) & (F.col("l_tax") == 0)
        odd = (F.col("l_returnflag") == "R") & (F.col("l_tax") == 0.08)
        sequence = text("l_linenumber")
        return self._staged("stop_times", self.table("lineitem").select(
            text("l_orderkey").alias("trip_id"),
            prefixed("S", "l_suppkey").alias("stop_id"),
            F.when(blank, "").otherwise(clock_text(hour, minute, second)).alias("arrival_time"),
            clock_text(hour, minute + 1, second).alias("departure_time"),
            F.when(odd, F.concat(F.lit("A"), sequence)).otherwise(sequence).alias("stop_sequence"),
        ))

    @cached_property
    def shapes(self) -> DataFrame:
        distance = text(F.col("l_extendedprice").cast("decimal(12,2)"))
        broken = F.when(F.col("l_tax") == 0, "").when(F.col("l_returnflag") == "R", "n/a").otherwise(distance)
        return self._staged("shapes", self.table("lineitem").select(
            prefixed("P", "l_partkey").alias("shape_id"),
            text(F.col("l_discount").cast("decimal(4,2)")).alias("shape_pt_lat"),
            text(F.col("l_tax").cast("decimal(4,2)")).alias("shape_pt_lon"),
            text("l_linenumber").alias("shape_pt_sequence"),
            broken.alias("shape_dist_traveled"),
        ))

    @cached_property
    def calendar(self) -> DataFrame:
        customer = self.table("customer").filter(F.col("c_mktsegment") != "MACHINERY")
        key, nation = F.col("c_custkey"), F.col("c_nationkey")
        start = day_plus(key % 26)
        marks = [
            F.when((key + nation * i) % 3 != 0, "1").otherwise("0").alias(day) for i, day in enumerate(WEEKDAYS)
        ]
        return self._staged("calendar", customer.select(
            prefixed("C", key).alias("service_id"), *marks,
            yyyymmdd(start).alias("start_date"), yyyymmdd(F.date_add(start, 4)).alias("end_date"),
        ))

    @cached_property
    def calendar_dates(self) -> DataFrame:
        customer = self.table("customer")
        key = F.col("c_custkey")
        service = prefixed("C", key).alias("service_id")
        kind = F.when(F.col("c_nationkey") % 2 == 0, "1").otherwise("2")
        first = customer.select(service, yyyymmdd(day_plus((key * 7) % 30)).alias("date"), kind.alias("exception_type"))
        second = customer.filter(F.col("c_acctbal") < 2000).select(
            service, yyyymmdd(day_plus((key * 11) % 30)).alias("date"), F.lit("2").alias("exception_type")
        )
        return self._staged("calendar_dates", first.union(second))

    @cached_property
    def transfers(self) -> DataFrame:
        return self._staged("transfers", self.table("supplier").select(
            prefixed("S", "s_suppkey").alias("from_stop_id"),
            prefixed("S", "s_nationkey").alias("to_stop_id"),
            text(F.col("s_nationkey") % 4).alias("transfer_type"),
            text(F.col("s_suppkey") % 600).alias("min_transfer_time"),
        ))

    @cached_property
    def timetable(self) -> Frames:
        return Frames(lambda name: getattr(self, name), STAGING_COLUMNS)

    # ---- dimensions of the timetable lens (some rows left out, so keys fail to resolve)

    @cached_property
    def feed_version(self) -> DataFrame:
        key = F.col("r_regionkey")
        return conform(self.table("region").select(
            (key + 10).alias("versionkey"),
            plus_seconds(F.lit(FIRST_DAY).cast("date"), key * 86_400).alias("ingestedat"),
            (key <= 2).alias("iscurrent"),
        ), DIMENSIONS["feed_version"])

    @cached_property
    def dims(self) -> Frames:
        names = ("agency", "route", "stop", "trip", "time", "feed_version", "date")
        return Frames(self._dim, names)

    def _dim(self, name: str) -> DataFrame:
        if name == "time":
            return dim_time(self.spark)
        if name == "date":
            return describe_dates(self.order_dates)
        if name == "feed_version":
            return self.feed_version
        if name == "agency":
            region, key = self.table("region"), F.col("r_regionkey")
            rows = region.filter(key != 4).select(
                (key + 1).alias("agencykey"), text(key).alias("agencyid"), F.col("r_name").alias("agencyname"),
                F.when(key % 2 == 0, "BUS").otherwise("RAIL").alias("mode"),
            )
        elif name == "route":
            nation, key = self.table("nation"), F.col("n_nationkey")
            rows = nation.filter(key != 7).select(
                (key + 1).alias("routekey"), (F.col("n_regionkey") + 1).alias("agencykey"), prefixed("R", key).alias("routeid"),
                F.col("n_name").alias("routeshortname"), prefixed("Line ", "n_name").alias("routelongname"),
                F.lit(12).alias("versionkey"),
            )
        elif name == "stop":
            key = F.col("s_suppkey")
            rows = self.table("supplier").filter("s_acctbal >= 0").select(
                (key + 1).alias("stopkey"), prefixed("S", key).alias("stopid"), F.lit(12).alias("versionkey")
            )
        else:
            key = F.col("o_orderkey")
            rows = self.table("orders").filter("o_orderpriority <> '5-LOW'").select(
                (key + 1).alias("tripkey"), text(key).alias("tripid"), F.lit(12).alias("versionkey")
            )
        return conform(rows, DIMENSIONS[name])

    @cached_property
    def order_dates(self) -> DataFrame:
        """Every calendar day from the first order to the last."""
        bounds = self.table("orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
        return bounds.select(F.explode(F.sequence("a", "b")).alias("service_date"))

    # ---- real-time frames

    @cached_property
    def stop_updates(self) -> DataFrame:
        date = day_plus(F.col("l_orderkey") % 30)
        scheduled = (20 + F.col("l_linenumber")) * 3600 + F.col("l_quantity").cast("int") * 60 + (F.col("l_partkey") % 60).cast("int")
        shipped = F.col("l_shipdate").cast("date")
        arrival = plus_seconds(date, scheduled + F.datediff(shipped, F.lit("1998-06-01").cast("date")))
        silent = (F.col("l_returnflag") == "N") & (F.col("l_tax") == 0.05)
        return conform(self.table("lineitem").select(
            text(F.col("l_suppkey") % 2).alias("agency_key"),
            text("l_orderkey").alias("trip_id"),
            date.alias("service_date"),
            prefixed("S", "l_suppkey").alias("stop_id"),
            F.col("l_linenumber").alias("stop_sequence"),
            F.when(~silent, arrival).alias("arrival_time_local"),
            F.when(F.col("l_linestatus") == "F", arrival).alias("departure_time_local"),
            F.col("l_shipdate").alias("feed_timestamp_utc"),
            F.lit(flags.REPORTED).alias("arrival_source"),
        ), STOP_UPDATES)

    @cached_property
    def positions(self) -> DataFrame:
        at = F.make_timestamp_ntz(
            F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), F.minute("ts"), F.second("ts")
        )
        trip = F.when(F.col("event_type") == "error", "").when(F.col("event_type") == "signup", prefixed("X", "user_id"))
        return conform(self.table("events").select(
            text(F.col("user_id") % 5).alias("agency_key"),
            trip.otherwise(text("user_id")).alias("trip_id"),
            prefixed("V", F.col("user_id") % 50).alias("vehicle_id"),
            F.col("value").alias("latitude"),
            (-F.col("value")).alias("longitude"),
            at.alias("timestamp_utc"),
            at.alias("timestamp_local"),
            (at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(30))).alias("feed_timestamp_utc"),
        ), VEHICLE_POSITIONS)

    @cached_property
    def trip_feed(self) -> DataFrame:
        """Nested snapshots, one per order line, some too short or empty."""
        moment = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * 86_400 + F.col("l_linenumber") * 7_200
        delay = F.col("l_quantity").cast("int")
        def event(condition: Column, time: Column) -> Column:
            return F.when(condition, F.struct(time.cast("bigint").alias("time"), delay.alias("delay")))

        arrives = event(F.col("l_returnflag") != "N", F.when(F.col("l_tax") == 0, 0).otherwise(moment + delay * 10))
        departs = event(F.col("l_linestatus") == "F", moment + delay * 20)
        nothing = event(F.lit(False), moment)
        def visit(stop: Column, sequence: Column, arrival: Column, departure: Column) -> Column:
            return F.struct(stop.alias("stop_id"), sequence.cast("int").alias("stop_sequence"),
                            arrival.alias("arrival"), departure.alias("departure"))

        visits = F.array(
            visit(prefixed("S", "l_suppkey"), F.col("l_linenumber"), arrives, departs),
            visit(prefixed("Q", "l_partkey"), F.col("l_linenumber") + 1, nothing, event(F.lit(True), moment + delay)),
        )
        trip = F.struct(
            text("l_orderkey").alias("trip_id"), F.lit("").alias("route_id"),
            (F.col("l_linenumber") % 3).cast("int").alias("direction_id"),
            (F.col("l_partkey") % 5).cast("int").alias("schedule_relationship"),
        )
        update = F.struct(trip.alias("trip"), visits.alias("stop_time_update"))
        entity = F.struct(update.alias("trip_update"), F.lit(None).cast("struct<timestamp: bigint>").alias("vehicle"))
        full = F.array(entity)
        return self.table("lineitem").select(
            text(F.col("l_suppkey") % 2).alias("agency_key"),
            F.lit("trip-updates").alias("feed_type"),
            (F.col("l_partkey") % 400).cast("int").alias("length"),
            F.struct(moment.alias("timestamp")).alias("header"),
            F.when(F.col("l_quantity") == 1, F.filter(full, lambda e: F.lit(False))).otherwise(full).alias("entity"),
        )

    @cached_property
    def vehicle_feed(self) -> DataFrame:
        """Nested snapshots, one per event."""
        moment = F.unix_date(F.col("ts").cast("date")).cast("bigint") * 86_400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
        kind = F.col("event_type")
        trip = F.when(kind != "error", F.struct(text("user_id").alias("trip_id"), prefixed("R", F.col("user_id") % 25).alias("route_id")))
        vehicle = F.when(kind != "view", F.struct(prefixed("V", F.col("user_id") % 50).alias("id")))
        place = F.struct(F.col("value").alias("latitude"), (-F.col("value")).alias("longitude"))
        body = F.struct(
            trip.alias("trip"), vehicle.alias("vehicle"), place.alias("position"),
            (F.col("user_id") % 9).cast("int").alias("current_stop_sequence"),
            (F.col("event_id") % 4).cast("int").alias("current_status"),
            F.when(kind == "click", 0).otherwise(moment).cast("bigint").alias("timestamp"),
        )
        return self.table("events").select(
            text(F.col("user_id") % 5).alias("agency_key"),
            F.lit("vehicle-positions").alias("feed_type"),
            (100 + F.col("event_id") % 400).cast("int").alias("length"),
            F.struct((moment + 30).alias("timestamp")).alias("header"),
            F.array(F.struct(F.lit(None).cast("struct<trip: struct<trip_id: string>>").alias("trip_update"), body.alias("vehicle"))).alias("entity"),
            (moment + 30 + (F.col("event_id") * 13) % 600).alias("polled_at"),
        )

    @cached_property
    def poll_log(self) -> DataFrame:
        failed = F.col("event_type") == "error"
        return self.table("events").select("ts", F.when(failed, 0).otherwise(1).alias("ok"), F.when(failed, 1).otherwise(0).alias("fail"))

    # ---- order lens: facts

    @cached_property
    def order_trips(self) -> DataFrame:
        """Orders with customer and nation: one trip each."""
        riders = self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        routes = self.table("nation").select("n_nationkey", "n_regionkey")
        joined = self.table("orders").join(riders, F.col("o_custkey") == F.col("c_custkey"))
        return joined.join(routes, F.col("c_nationkey") == F.col("n_nationkey"))

    @cached_property
    def fact_trip(self) -> DataFrame:
        """Trip fact: orders on the Monday of their week."""
        added = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW")
        ran = F.col("o_orderstatus") == "O"
        status = F.when(added, flags.ADDED).when(ran, flags.OPERATED)
        status = status.when(F.col("o_orderstatus") == "P", flags.MISSED).otherwise(flags.CANCELLED)
        day = F.date_sub(F.col("o_orderdate").cast("date"), F.weekday("o_orderdate"))
        begin = ((F.col("o_orderkey") * 37) % 1440).cast("int")
        length = (F.col("o_custkey") % 180).cast("int")
        vrm = F.col("o_totalprice").cast("decimal(12,2)").cast("decimal(14,4)") / F.lit(10_000).cast("decimal(5,0)")
        vrh = ((F.col("o_custkey") % 500) + 1).cast("decimal(6,0)") / F.lit(100).cast("decimal(3,0)")
        return conform(self.order_trips.select(
            F.when(added, 0).otherwise(F.col("o_orderkey") + 1).alias("tripkey"),
            date_key(day).alias("datekey"),
            (F.col("n_regionkey") + 1).alias("agencykey"),
            (F.col("c_nationkey") + 1).alias("routekey"),
            F.lit(12).alias("versionkey"),
            status.alias("tripstatus"),
            F.when(ran, plus_seconds(day, begin * 60)).alias("actualstarttime"),
            F.when(ran, plus_seconds(day, (begin + length) * 60)).alias("actualendtime"),
            F.when(ran & (F.col("o_custkey") % 4 != 0), length + 1).alias("actualpingcount"),
            vrm.alias("scheduledvrm"), vrh.alias("scheduledvrh"), vrm.alias("reportedvrm"), vrh.alias("reportedvrh"),
            (F.col("o_custkey") % 7 == 0).alias("isestimated"),
            ((F.col("c_mktsegment") == "MACHINERY") & (F.col("o_orderkey") % 20 == 0)).alias("isspecialevent"),
            F.lit(False).alias("isofficial"),
        ), FACT_TRIP)

    @cached_property
    def fact_stop(self) -> DataFrame:
        """Stop fact: order lines on their order date; one day of shipping delay plays one second."""
        lines = self.table("lineitem").select(
            text("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence"), "l_orderkey",
            "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus",
        )
        trips = self.order_trips.select("o_orderkey", "o_orderdate", "o_orderpriority", "c_nationkey", "n_regionkey")
        rows = mark_ends(lines).join(trips, F.col("l_orderkey") == F.col("o_orderkey"))
        dev = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
        seen = ~((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"))
        date = F.col("o_orderdate").cast("date")
        return conform(rows.select(
            F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(F.col("l_orderkey") + 1).alias("tripkey"),
            (F.col("c_nationkey") + 1).alias("routekey"),
            (F.col("l_suppkey") + 1).alias("stopkey"),
            date_key(date).alias("datekey"),
            (F.col("n_regionkey") + 1).alias("agencykey"),
            F.col("stop_sequence").alias("stopsequence"),
            F.when(seen, dev).alias("arrivaldevseconds"),
            F.when(seen, flags.REPORTED).otherwise(flags.FALLBACK).alias("arrivalsource"),
            F.when(seen, flags.on_time(dev)).alias("isontime"),
            F.when(seen, flags.late(dev)).alias("islate"),
            F.when(seen, flags.early(dev)).alias("isearly"),
            F.col("is_origin").alias("isoriginstop"),
            F.col("is_terminal").alias("isterminalstop"),
            F.lit(False).alias("ismissed"),
            (~seen).alias("isestimated"),
            F.lit(False).alias("isofficial"),
        ), FACT_STOP)

    # ---- stored facts as the inspection finds them: some days absent, some still open

    @cached_property
    def stored_stops(self) -> DataFrame:
        slot = (F.col("l_partkey") % 20).cast("int")
        open_row = (slot < 8) & (F.col("l_returnflag") == "N")
        return conform(self.table("lineitem").select(
            (F.col("l_orderkey") + 1).alias("tripkey"), date_key(day_plus(slot * 2)).alias("datekey"),
            F.when(open_row, flags.FALLBACK).otherwise(flags.REPORTED).alias("arrivalsource"),
        ), FACT_STOP)

    @cached_property
    def stored_trips(self) -> DataFrame:
        slot = (F.col("o_custkey") % 12).cast("int")
        open_row = (slot < 5) & (F.col("o_orderstatus") == "P")
        return conform(self.table("orders").select(
            (F.col("o_orderkey") + 1).alias("tripkey"), date_key(day_plus(slot * 3)).alias("datekey"),
            (F.col("o_custkey") % 5 + 1).alias("agencykey"),
            F.when(open_row, flags.MISSED).otherwise(flags.OPERATED).alias("tripstatus"),
        ), FACT_TRIP)

    @cached_property
    def stored_days(self) -> DataFrame:
        key = F.col("c_custkey")
        return conform(self.table("customer").filter(key % 60 < 50).select(
            (key % 5 + 1).alias("agencykey"), date_key(day_plus((key % 12) * 3)).alias("datekey"),
        ).distinct(), FACT_SERVICE_DAY)
