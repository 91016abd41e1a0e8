"""Mixing sources to target weights by weighted fair queueing.

Every document may enter ``passes`` times. Within its source the copies stand in an order shuffled by a hash, pass
after pass; a copy's virtual finish time is the number of words up to its end divided by the source's target. Copies
of all sources merge by finish time, and the mix ends at the total budget.

Running sums never gather a source in one task: words are first added up by (source, pass, slice of the hash), the
slices are summed in order, and the sum within a slice is added to what came before. The merged order is cut the
same way over slices of the finish time; only the slice in which the budget ends is summed row by row.

Edge cases: a null text has size 0; a null source is a source of its own, in last place; a source without words has the
target 0 and gives nothing; equal rows are separate documents; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayside.llm.common import WORD, staged, text_of

#: Slices of the shuffle hash (first hex digits) and of the finish time, which counts up to ``LATE``.
HASH_DIGITS, FINISH_SLICES, LATE = 3, 16384, 4.0


def n_words(column: str = "text") -> Column:
    """Number of words of a text."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("bigint")


def targets(sized: DataFrame, weights: Sequence[int], share: float, passes: int) -> DataFrame:
    """``source, source_size, target`` of each source.

    Sources in order of code points, null last, have ``weights`` in turn. The budget, ``share`` times all words, is dealt
    by weight; no source gets over ``passes`` times its size, and what is left over is dealt again. Filling
    sources in order of the level at which they are full finds that in one pass over one row per source.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by_level = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, everything = by_level.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    rows = sizes.select(
        "source", "source_size", weight.alias("weight"), (F.lit(float(passes)) * F.col("source_size")).alias("full")
    ).withColumns(
        {
            "left": F.lit(float(share)) * F.sum("source_size").over(everything) - (F.sum("full").over(upto) - F.col("full")),
            "unfilled": F.sum("weight").over(everything) - (F.sum("weight").over(upto) - F.col("weight")),
            "turn": F.row_number().over(by_level),
        }
    ).withColumn("level", F.col("left") / F.col("unfilled"))
    capped = F.col("full") <= F.col("level") * F.col("weight")
    # The level that holds is the one seen by the first source that is not full.
    level = F.min(F.when(~capped, F.struct("turn", "level"))).over(everything)["level"]
    return rows.select(
        "source", "source_size", F.when(capped, F.col("full")).otherwise(F.col("weight") * level).alias("target")
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, passes: int = 2) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, copies``.

    ``taken`` counts the words the mix takes from the document, repeats included, ``copies`` how often it takes it.
    """
    chosen = _queued(_sized(docs.select("doc_id", "source", "text")), weights, share, passes)
    return chosen.select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, passes: int = 2) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it was taken."""
    kept = staged(docs.select(F.struct("*").alias("document")).withColumn("row", F.monotonically_increasing_id()), "mix-docs")
    sized = kept.select("row", "document.doc_id", "document.source", "document.text").withColumn("size", n_words()).drop("text")
    chosen = _queued(staged(sized, "mix-sizes"), weights, share, passes).where("copies > 0").select("row", "copies")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return kept.join(chosen, "row").select("document", times.alias("copy")).select("document.*")


def _sized(docs: DataFrame) -> DataFrame:
    sized = docs.select("doc_id", "source", n_words().alias("size"))
    return staged(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def _queued(sized: DataFrame, weights: Sequence[int], share: float, passes: int) -> DataFrame:
    named = F.concat_ws("", F.when(F.col("source").isNotNull(), "="), "source")
    goal = staged(targets(sized, weights, share, passes).withColumn("name", named), "mix-targets")
    copies = (
        sized.withColumn("name", named)
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        .withColumn("key", F.md5(F.concat_ws(":", "doc_id", "pass").cast("binary")))
        .withColumn("part", F.substring("key", 1, HASH_DIGITS))
    )
    place = ["name", "pass", "part"]
    in_turn = Window.partitionBy("name").orderBy("pass", "part").rowsBetween(Window.unboundedPreceding, 0)
    parts = copies.groupBy(*place).agg(F.sum("size").alias("words")).select(
        *place, (F.sum("words").over(in_turn) - F.col("words")).alias("earlier")
    ).join(goal.drop("source"), "name")
    within = Window.partitionBy(*place).orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    summed = copies.withColumn("inside", F.sum("size").over(within)).join(parts, place)
    finish = (F.col("earlier") + F.col("inside")) / F.nullif("target", F.lit(0.0))
    timed = staged(
        summed.withColumn("finish", finish).withColumn(
            "slice", F.floor(F.least(F.coalesce("finish", F.lit(LATE)), F.lit(LATE)) * FINISH_SLICES)
        ).drop("name", "pass", "part", "earlier", "inside"),
        "mix-finish",
    )
    so_far = F.sum("words").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    total = F.lit(float(share) / passes) * F.sum("words").over(Window.partitionBy())
    slices = timed.groupBy("slice").agg(F.sum("size").alias("words")).select(
        "slice", (so_far - F.col("words")).alias("ahead"), so_far.alias("through"), total.alias("budget")
    )
    # At most LATE * FINISH_SLICES + 1 rows.
    marked = timed.join(F.broadcast(slices), "slice")
    merged = Window.partitionBy("slice").orderBy("finish", "key", "doc_id", "size", "row")
    merged = merged.rowsBetween(Window.unboundedPreceding, 0)
    split = "finish is not null and ahead < budget and through > budget"
    whole = marked.where(f"not ({split})").withColumn("in", F.expr("finish is not null and through <= budget"))
    edge = marked.where(split).withColumn("in", F.col("ahead") + F.sum("size").over(merged) <= F.col("budget"))
    one = ["doc_id", "source", "size", "source_size", "target"]
    return whole.unionByName(edge).groupBy("row").agg(
        *[F.first(c).alias(c) for c in one],
        F.sum(F.when(F.col("in"), F.col("size")).otherwise(0)).alias("taken"),
        F.sum(F.col("in").cast("int")).alias("copies"),
    )
