"""Surrogate keys, dimension look-ups and key-based set operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import zero_key
from .latest import keep_latest


def current_version(versions: DataFrame) -> DataFrame:
    """Key of the newest feed version marked current (no row if none is)."""
    current = versions.filter("iscurrent").select("versionkey", "ingestedat")
    return current.orderBy(F.desc("ingestedat"), F.desc("versionkey")).limit(1).select("versionkey")


def version_key(versions: DataFrame) -> Column:
    """The current version key as a value, 0 when there is none.

    A scalar subquery: evaluated once and inlined, so attaching it costs no join.
    """
    return zero_key(current_version(versions).scalar())


def current_rows(dim: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows of a versioned dimension that belong to the current feed version."""
    return dim.filter(F.col("versionkey") == version_key(versions))


def resolve_key(df: DataFrame, dim: DataFrame, natural: str, dim_natural: str, *keys: str) -> DataFrame:
    """Left-join ``keys`` of a dimension by natural key, 0 where unresolved.

    No broadcast hint: Spark broadcasts a dimension below its size threshold and otherwise
    shuffles with skew splitting.
    """
    looked_up = dim.select(F.col(dim_natural).alias("_natural"), *keys)
    joined = df.join(looked_up, df[natural] == looked_up["_natural"], "left").drop("_natural")
    return joined.select(*df.columns, *[zero_key(k).alias(k) for k in keys])


def resolve_route(df: DataFrame, dim_route: DataFrame, dim_agency: DataFrame) -> DataFrame:
    """Route key by natural key, and the agency key the route points to if that agency exists."""
    agencies = dim_agency.select(F.col("agencykey").alias("_agency"))
    routes = dim_route.join(agencies, dim_route["agencykey"] == agencies["_agency"], "left")
    routes = routes.select("routeid", "routekey", F.col("_agency").alias("agencykey"))
    return resolve_key(df, routes, "route_id", "routeid", "routekey", "agencykey")


def fresh_key(df: DataFrame, key: str) -> DataFrame:
    """The frame with a text key rebuilt, so that the next join on it gets its own shuffle.

    Adaptive execution splits a skewed join only where both inputs come straight from a shuffle.
    An input already partitioned by the key, as after an aggregation, would join in the same stage
    and a hot key on the other side would stay in one task. The price is one more shuffle of the
    smaller, reduced input; nothing where Spark broadcasts it.
    """
    return df.withColumn(key, F.concat(F.col(key), F.lit("")))


def newest_rows(dim: DataFrame, natural: str) -> DataFrame:
    """One row per natural key: that of the newest feed version, so coexisting versions never fan out."""
    return fresh_key(keep_latest(dim, [natural], ["versionkey"]), natural)


def newest_dims(dims: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Dimensions with the versioned ones reduced to their newest rows."""
    natural = {"trip": "tripid", "route": "routeid", "stop": "stopid"}
    return {name: newest_rows(dims[name], natural[name]) if name in natural else dims[name] for name in dims}


def narrow(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` occurs in ``wanted``, a short list with the same column.

    The bounds are scalar subqueries: on a table partitioned by the column they are known before
    files are listed, so partitions outside the list's span are never opened. The semi-join then
    keeps exactly the listed values; the list is broadcast, because a list made from local rows has no
    known size, and Spark would move all of ``df`` before it sees how short it is.
    """
    low, high = (wanted.agg(f(column)).scalar() for f in (F.min, F.max))
    inside = df.filter((F.col(column) >= low) & (F.col(column) <= high))
    return inside.join(F.broadcast(wanted.select(column).distinct()), column, "left_semi").select(*df.columns)


def scope_to(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` occurs in ``wanted``, of which only the distinct keys are moved."""
    return df.join(wanted.select(key).distinct(), key, "left_semi").select(*df.columns)


def new_rows_only(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose natural key is not stored yet; key 0 of stored rows, which stands for unresolved, is not compared."""
    stored = existing.filter(F.col(keys[0]) != 0).select(*keys)
    return df.join(stored, list(keys), "left_anti").select(*df.columns)


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose non-null ``key`` has no parent."""
    wanted = parent.select(F.col(parent_key or key).alias(key))
    return child.filter(F.col(key).isNotNull()).join(wanted, key, "left_anti").select(*child.columns)


def bucket_of(natural: Sequence[str]) -> Column:
    """One of 4096 evenly filled buckets of a natural key."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in natural])
    return F.substring(F.md5(text), 1, 3)


def assign_keys(rows: DataFrame, natural: Sequence[str], key: str, after: Column | None = None) -> DataFrame:
    """Dense integer keys for distinct natural keys, without sorting them in one task.

    Keys count on from ``after``. Rows are numbered inside evenly filled buckets and each bucket is
    shifted by the number of rows in the buckets before it; only that list of at most 4096 counts
    is ordered in a single task. The numbering depends on the data alone, so a retried task
    repeats it exactly.
    """
    return _numbered(rows, natural, key, F.lit(0) if after is None else after, F.lit(None)).select(key, *rows.columns)


def _numbered(rows: DataFrame, natural: Sequence[str], key: str, start: Column, known: Column) -> DataFrame:
    """``rows`` with ``key``: that of ``known``, and for rows without one the next free number after ``start``."""
    bucketed = rows.withColumns({"_bucket": bucket_of(natural), "_new": known.isNull()})
    counts = bucketed.groupBy("_bucket").agg(F.count_if("_new").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bucket", "_new").orderBy(*natural))
    numbered = bucketed.withColumn("_rank", inside).join(F.broadcast(offsets), "_bucket")
    return numbered.withColumn(key, F.coalesce(known, start + F.col("_offset") + F.col("_rank")).cast("bigint"))


def extend_keys(rows: DataFrame, natural: Sequence[str], key: str, previous: DataFrame | None) -> DataFrame:
    """Keys stable across loads: known natural keys keep theirs, new ones count on from the maximum."""
    if previous is None:
        return assign_keys(rows, natural, key)
    known = previous.select(*natural, F.col(key).alias("_known"))
    highest = zero_key(previous.agg(F.max(key)).scalar())
    matched = rows.join(known, list(natural), "left").select(*rows.columns, "_known")
    return _numbered(matched, natural, key, highest, F.col("_known")).select(key, *rows.columns)
