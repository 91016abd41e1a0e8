"""Keep the newest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: Sequence[str], newest: Sequence[Column | str]) -> DataFrame:
    """One row per ``keys``: the greatest by ``newest``, ties broken by all remaining columns.

    The total order makes the result independent of file and task order. Filtering ``row_number``
    to 1 lets Spark put a group limit before the shuffle, so a hot key sends one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [F.desc(c) if isinstance(c, str) else c for c in newest] + [F.desc(c) for c in rest]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def latest_row(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The single newest row of a frame (sorts only candidates of each task)."""
    rest = [c for c in df.columns if c not in by]
    return df.orderBy(*[F.desc(c) for c in [*by, *rest]]).limit(1)


def latest_run(audit: DataFrame, day) -> DataFrame:
    """The last audit run of ``day``."""
    return latest_row(audit.filter(F.col("run_date") == F.lit(day).cast("date")), ["run_timestamp"])
