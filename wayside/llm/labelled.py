"""Bounded samples of labelled texts for training, and scoring of texts block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from wayside.llm.common import remainder, text_of

#: Texts longer than this are not trained on (they are scored whole).
LONGEST = 40_000
#: Every fifth id, by its crc32, is held out.
FOLDS = 5


def held_out(column: str = "doc_id") -> Column:
    return remainder(column, FOLDS) == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> pd.DataFrame:
    """``text, label`` of at most ``per_class`` labelled rows of either class outside the held-out fold.

    Rows are taken in the order of a hash of their id, so the sample does not depend on how the table is stored. Its
    ids, at most twice ``per_class``, are broadcast to find the texts.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        ~held_out() & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)
    )
    picked = [usable.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select("doc_id", text_of().alias("text")).where(F.length("text") <= LONGEST).join(chosen, "doc_id")
    return rows.toPandas().sort_values(["doc_id", "text"], ignore_index=True)[["text", "label"]]


def blocks(texts: list[str], size: int) -> Iterator[list[str]]:
    """Consecutive texts of about ``size`` characters together."""
    held, n = [], 0
    for text in texts:
        if held and n + len(text) > size:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def scorer(make: Callable[[], Callable[[list[str]], np.ndarray]], size: int = 1 << 21) -> Callable[[Column], Column]:
    """A column function from text to score; ``make`` builds the model's function once per task."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for texts in batches:
            parts = [run(b) for b in blocks(["" if t is None else t for t in texts], size)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score


def scored(docs: DataFrame, score: Callable[[Column], Column], threshold: float) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    out = docs.select("doc_id", held_out().alias("held_out"), score(text_of()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
