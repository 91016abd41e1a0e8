"""Dimension rows with the days they hold: one row per key and unchanged stretch of feed versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First day a row holds, and the first day it no longer does (NULL: still valid).
VALIDITY = "validfrom date, validto date"


def merge_history(history: DataFrame, fresh: DataFrame, natural: Sequence[str], key: str, day) -> DataFrame:
    """The history after ``fresh`` became the dimension on ``day``.

    A natural key whose attributes are as before keeps its open row; with other attributes that row ends on ``day`` and one with
    the same surrogate key begins; a key absent from ``fresh`` ends, and one that comes back begins anew under its old key. Ended rows pass
    through. One full join of the open rows with ``fresh``; running it again for the same day changes nothing.
    """
    since = F.lit(day).cast("date")
    columns = [c for c in history.columns if c not in ("validfrom", "validto")]
    attributes = [c for c in columns if c not in (*natural, key, "versionkey")]
    ended = history.filter("validto is not null")
    old = history.filter("validto is null").select(*natural, F.struct(*columns, "validfrom").alias("_old"))
    new = fresh.select(*natural, F.struct(*columns).alias("_new"))
    both = old.join(new, list(natural), "full")
    def values(side: str) -> Column:
        return F.struct(*[F.col(f"{side}.{c}") for c in attributes]) if attributes else F.lit(True)

    gone, came = F.col("_new").isNull(), F.col("_old").isNull()
    same = ~gone & ~came & values("_old").eqNullSafe(values("_new"))
    def row(side: str, start: Column, end: Column) -> Column:
        return F.struct(*[F.col(f"{side}.{c}").alias(c) for c in columns], start.alias("validfrom"), end.alias("validto"))

    started, open_end = F.col("_old.validfrom"), F.lit(None).cast("date")
    kept = F.array(row("_old", started, open_end))
    replaced = F.array(row("_old", started, since), row("_new", since, open_end))
    rows = F.when(same, kept).when(came, F.array(row("_new", since, open_end))).when(gone, F.array(row("_old", started, since))).otherwise(replaced)
    changed = both.select(F.explode(rows).alias("_row")).select("_row.*")
    # What began on this very day and is replaced on it held no day.
    held = changed.filter("validto is null or validfrom < validto")
    return ended.unionByName(held.select(*history.columns))


def valid_on(history: DataFrame, day) -> DataFrame:
    """The rows that hold on ``day``, without their validity."""
    on = F.lit(day).cast("date")
    rows = history.filter((F.col("validfrom") <= on) & (F.col("validto").isNull() | (on < F.col("validto"))))
    return rows.drop("validfrom", "validto")


def known_keys(history: DataFrame, natural: Sequence[str], key: str) -> DataFrame:
    """Every natural key ever seen with its surrogate key."""
    return history.groupBy(*natural).agg(F.min(key).alias(key))
