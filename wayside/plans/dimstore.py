"""Stored dimensions: keys that last, the days each row holds, and loads that take effect as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, dims
from ..operators.history import VALIDITY, known_keys, merge_history, valid_on
from ..schemas import DIMENSIONS
from ..sources.sinks import read_table
from ..sources.static import delete_path, list_files

# Natural key of each dimension that follows the timetable, in the order in which they refer to one another.
NATURAL_KEYS = {
    "agency": ["agencyid"],
    "route": ["routeid"],
    "stop": ["stopid"],
    "service": ["serviceid"],
    "shape": ["shapeid"],
    "direction": ["routekey", "directionid"],
    "trip": ["tripid"],
    "calendar_exception": ["serviceid", "exceptiondate", "exceptiontype"],
    "stop_transfer": ["fromstopkey", "tostopkey", "transfertype"],
}

GENERATIONS = "generation string, loadedat timestamp, loadday date"


@dataclass
class DimensionStore:
    """Dimensions below ``root``. A load writes all of them into a folder of its own, its generation, and then names it in a list that only
    grows; readers take the newest generation named, so a load that fails leaves what was there."""

    spark: SparkSession
    root: str

    def generation(self) -> str | None:
        """The generation in force."""
        named = read_table(self.spark, f"{self.root}/generations", GENERATIONS)
        last = named.agg(F.max(F.struct("loadedat", "generation")).alias("last")).first()["last"]
        return last["generation"] if last else None

    def _read(self, generation: str | None, name: str, ddl: str) -> DataFrame:
        if generation is None:
            return self.spark.createDataFrame([], ddl)
        return read_table(self.spark, f"{self.root}/generation={generation}/{name}", ddl)

    def history(self, name: str) -> DataFrame:
        """All rows of a dimension with the days they hold."""
        return self._read(self.generation(), name, f"{DIMENSIONS[name]}, {VALIDITY}")

    def versions(self) -> DataFrame:
        """Feed versions, the current one marked."""
        return self._read(self.generation(), "feed_version", DIMENSIONS["feed_version"])

    def as_of(self, day) -> dict[str, DataFrame]:
        """The dimensions as they were on ``day``; facts of that day resolve their keys with these."""
        generation = self.generation()
        frames = {name: valid_on(self._read(generation, name, f"{DIMENSIONS[name]}, {VALIDITY}"), day) for name in NATURAL_KEYS}
        return {**frames, "feed_version": self._read(generation, "feed_version", DIMENSIONS["feed_version"])}

    def current(self) -> dict[str, DataFrame]:
        """The dimensions of the newest load."""
        generation = self.generation()
        frames = {
            name: self._read(generation, name, f"{DIMENSIONS[name]}, {VALIDITY}").filter("validto is null").drop("validfrom", "validto")
            for name in NATURAL_KEYS
        }
        return {**frames, "feed_version": self._read(generation, "feed_version", DIMENSIONS["feed_version"])}

    def load(self, stg: Mapping[str, DataFrame], day, feeds: DataFrame | None = None, modes: DataFrame | None = None) -> dict[str, DataFrame]:
        """Bring the dimensions to the staged timetable of ``day`` and return them.

        ``feeds`` (feedhash, ingestedat, …) become feed versions. Each dimension is written before those that refer to it are
        built, and read back from its files.
        """
        before, here = self.generation(), uuid.uuid4().hex
        folder = f"{self.root}/generation={here}"
        done: dict[str, DataFrame] = {}

        def write(name: str, rows: DataFrame, ddl: str) -> DataFrame:
            rows.write.parquet(f"{folder}/{name}")
            return read_table(self.spark, f"{folder}/{name}", ddl)

        versions = self._read(before, "feed_version", DIMENSIONS["feed_version"])
        if feeds is not None:
            versions = audit.register_feed_version(versions, feeds)
        versions = done["feed_version"] = write("feed_version", versions, DIMENSIONS["feed_version"])
        for name, natural in NATURAL_KEYS.items():
            ddl = f"{DIMENSIONS[name]}, {VALIDITY}"
            history = self._read(before, name, ddl)
            fresh = self._build(name, stg, done, versions, known_keys(history, natural, f"{name.replace('_', '')}key"), modes)
            merged = write(name, merge_history(history, fresh, natural, f"{name.replace('_', '')}key", day), ddl)
            done[name] = merged.filter("validto is null").drop("validfrom", "validto")
        named = self.spark.range(1).select(
            F.lit(here).alias("generation"), F.current_timestamp().alias("loadedat"), F.lit(day).cast("date").alias("loadday")
        )
        named.coalesce(1).write.mode("append").parquet(f"{self.root}/generations")
        return done

    def _build(self, name: str, stg: Mapping, done: Mapping, versions: DataFrame, known: DataFrame, modes: DataFrame | None) -> DataFrame:
        match name:
            case "agency":
                return dims.dim_agency(stg["agency"], modes, known)
            case "route":
                return dims.dim_route(stg["routes"], done["agency"], versions, known)
            case "stop":
                return dims.dim_stop(stg["stops"], versions, known)
            case "service":
                return dims.dim_service(stg["calendar"], stg["calendar_dates"], versions, known)
            case "shape":
                return dims.dim_shape(stg["shapes"], versions, known)
            case "direction":
                return dims.dim_direction(stg["trips"], done["route"], known)
            case "trip":
                return dims.dim_trip(stg["trips"], done["route"], done["service"], done["direction"], done["shape"], versions, known)
            case "calendar_exception":
                return dims.dim_calendar_exception(stg["calendar_dates"], versions, known)
            case _:
                return dims.dim_stop_transfer(stg["transfers"], done["stop"], versions, known)

    def drop_old(self, keep: int = 2) -> list[str]:
        """Remove all generations but the newest ``keep`` named ones, and those that no load has named; returns their names.

        Not while a load runs: its generation is not named yet."""
        named = read_table(self.spark, f"{self.root}/generations", GENERATIONS)
        newest = {r["generation"] for r in named.orderBy(F.desc("loadedat"), F.desc("generation")).limit(keep).collect()}
        folders = {path.rsplit("generation=", 1)[1].strip("/"): path for path in list_files(self.spark, f"{self.root}/generation=*")}
        old = sorted(set(folders) - newest)
        for generation in old:
            delete_path(self.spark, folders[generation])
        return old
