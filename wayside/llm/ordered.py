"""Documents in ascending order of their id, in buckets of about equal size."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from wayside.llm.common import text_of

LOWEST = -(1 << 63)


@dataclass(frozen=True)
class Bounds:
    """Lower bounds of the buckets, and for each bucket that has rows its first id; both as many as there are buckets."""

    starts: tuple[int, ...]
    firsts: dict[int, int]

    def bucket(self, ids: pd.Series) -> np.ndarray:
        return np.searchsorted(np.array(self.starts, dtype=np.int64), ids.to_numpy(dtype=np.int64), side="right")


def bounds(docs: DataFrame, buckets: int) -> Bounds:
    """Bucket bounds from approximate quantiles of ``doc_id``; a missing id counts as the lowest one."""
    ids = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).cast("bigint").alias("doc_id"))
    at = [i / buckets for i in range(1, buckets)] or [0.5]
    found = ids.agg(F.percentile_approx("doc_id", at, 20 * buckets).alias("q")).head()["q"] or []
    starts = Bounds(tuple(sorted(set(found))), {})
    bucket = pandas_udf(lambda s: pd.Series(starts.bucket(s).astype("int32")), "int")
    firsts = ids.groupBy(bucket("doc_id").alias("bucket")).agg(F.min("doc_id").alias("first")).collect()
    return Bounds(starts.starts, {r["bucket"]: r["first"] for r in firsts})


def in_order(docs: DataFrame, at: Bounds, partitions: int, guests: bool = False) -> DataFrame:
    """``bucket, guest, doc_id, text`` with whole buckets in a partition, dealt in turn, sorted within.

    With ``guests``, the rows with a bucket's first id also follow the rows of the bucket before (the first of all
    those of the last), marked as guests. Rows of the same id are in the order of a hash of their text.
    """
    ranked = sorted(at.firsts)
    before = {at.firsts[b]: ranked[i - 1] for i, b in enumerate(ranked)} if guests else {}

    def places(ids: pd.Series) -> pd.Series:
        own = at.bucket(ids)
        return pd.Series([[2 * b] + ([2 * before[i] + 1] if i in before else []) for b, i in zip(own.tolist(), ids.tolist())])

    place = pandas_udf(places, "array<int>")
    key = F.coalesce("doc_id", F.lit(LOWEST)).cast("bigint")
    rows = docs.select(key.alias("order"), "doc_id", text_of().alias("text"))
    dealt = rows.withColumn("place", F.explode(place("order"))).withColumn("tie", F.xxhash64("text"))
    return (
        dealt.withColumns({"bucket": F.shiftright("place", 1), "guest": F.col("place") % 2})
        .repartitionById(partitions, "bucket")
        .sortWithinPartitions("bucket", "guest", "order", "tie")
        .select("bucket", "guest", "doc_id", "text")
    )
