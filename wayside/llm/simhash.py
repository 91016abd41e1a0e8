"""SimHash near-deduplication by a self-join of a binary trie.

Fingerprints are the leaves of a trie, one bit per level. The join walks pairs of nodes of equal depth from
(root, root) down and adds up the bits in which the two differ; a pair over the error budget is pruned with
everything below it. Spark holds the upper part of that walk as a table of pairs: each fingerprint goes with every
surviving pair its node is in. A pair of few fingerprints is finished inside one task, a larger one goes down some more
bits, so no task gets more than ``PAIR_ROWS`` fingerprints, however many are alike (64 bits down a node is one
fingerprint). A task returns a spanning forest of the links it found, not the links; components are then merged
by repeatedly taking over the smallest neighbour.

Only distinct fingerprints enter the join, so copies cost nothing, and one fingerprint has at most 2081 others
within two bits.

Edge cases: a null text counts as empty; texts without words have the fingerprint zero and link like any other; texts of
fewer words than a shingle are one shingle; rows without ``doc_id`` are fingerprinted and linked but never name a
component; equal rows each come out; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wayside.llm.common import staged, text_of

BITS, SEED = 64, 42
#: Fingerprints in one pair of nodes that a task finishes by itself, and bits that larger ones go down at once.
PAIR_ROWS, STEP = 32768, 4
#: Node pairs held at once inside a task.
FRONTIER = 1 << 18


def text_fingerprint(text: str, n: int) -> int:
    """SimHash of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(n)))] if len(words) >= n else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype=np.uint64)
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """``doc_id, bits``: the fingerprint of every text as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            bits = np.fromiter((text_fingerprint(t.as_py(), n) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(compute, "doc_id bigint, bits bigint")


def trie_links(bits: np.ndarray, first: tuple[int, int], second: tuple[int, int], depth: int, errors: int, budget: int):
    """Pairs of positions in the sorted array ``bits`` that differ in at most ``budget`` bits, in blocks.

    ``first`` and ``second`` are the ranges of two nodes at ``depth`` whose prefixes differ in ``errors`` bits; they may be
    the same node. The walk keeps a stack of blocks of node pairs, so its memory is bounded.
    """
    ones: dict[int, np.ndarray] = {}

    def middle(lo, hi, level):
        if level not in ones:
            bit = (bits >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            ones[level] = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
        return hi - (ones[level][hi] - ones[level][lo])

    todo = [(depth, np.array([[*first, *second, errors]], dtype=np.int32))]
    while todo:
        level, pairs = todo.pop()
        if len(pairs) > FRONTIER:
            todo += [(level, pairs[at : at + FRONTIER]) for at in range(0, len(pairs), FRONTIER)]
            continue
        a, b, c, d, e = pairs.T
        small = ((b - a) * (d - c).astype(np.int64) <= 16) | (level == BITS)
        if small.any():
            s = pairs[small]
            wide = (s[:, 3] - s[:, 2]).astype(np.int64)
            count = (s[:, 1] - s[:, 0]).astype(np.int64) * wide
            owner = np.repeat(np.arange(len(s)), count)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            i, j = s[owner, 0] + inner // wide[owner], s[owner, 2] + inner % wide[owner]
            near = (i != j) & (np.bitwise_count(bits[i] ^ bits[j]) <= budget)
            if near.any():
                yield i[near], j[near]
        if small.all():
            continue
        a, b, c, d, e = pairs[~small].T
        m, k = middle(a, b, level), middle(c, d, level)
        same = a == c
        parts = [np.stack([a, m, c, k, e], 1), np.stack([m, b, k, d, e], 1), np.stack([a, m, k, d, e + 1], 1)]
        parts.append(np.stack([m, b, c, k, e + 1], 1)[~same])
        below = np.concatenate(parts)
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget)]
        if len(below):
            todo.append((level + 1, below))


def merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (smallest positions) after also linking ``i`` with ``j``; ``root`` points at roots."""
    while True:
        p, q = root[i], root[j]
        apart = p != q
        if not apart.any():
            return root
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := root[root], root):
            root = up


def _forest(frame: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Links that join the fingerprints of a node pair into components: ``a`` is the smallest, in unsigned order."""
    bits = np.unique(frame["bits"].to_numpy().view(np.uint64))
    depth, left, right = (int(frame[c].iloc[0]) for c in ("depth", "lo", "hi"))
    shift = np.uint64(BITS - depth)
    prefix = (bits >> shift) if depth else np.zeros(len(bits), dtype=np.uint64)
    ranges = [tuple(int(np.searchsorted(prefix, np.uint64(x), side)) for side in ("left", "right")) for x in (left, right)]
    root = np.arange(len(bits))
    for i, j in trie_links(bits, *ranges, depth, int.bit_count(left ^ right), budget):
        root = merged(root, i, j)
    linked = np.flatnonzero(root != np.arange(len(bits)))
    return pd.DataFrame({"a": bits[root[linked]].view(np.int64), "b": bits[linked].view(np.int64)})


def links(distinct: DataFrame, budget: int = 2, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """A set of links ``a, b`` between fingerprints that has the components of all links within ``budget`` bits."""
    spark = distinct.sparkSession
    total = distinct.count()
    # First split: as deep as even fingerprints need it.
    step = max(STEP, int(np.ceil(np.log2(max(1, 8 * total / pair_rows)))))
    step = min(step, 16)
    pairs = distinct.select("bits", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi"))
    found, larger = [], total > pair_rows
    while larger:
        pairs = staged(_deeper(pairs, step, budget), "simhash-pairs")
        node = ["depth", "lo", "hi"]
        sizes = staged(pairs.groupBy(*node).agg(F.count("*").alias("n")), "simhash-sizes")
        larger = not sizes.where((F.col("n") > pair_rows) & (F.col("depth") < BITS - STEP)).isEmpty()
        if larger:
            ready = (F.col("n") <= pair_rows) | (F.col("depth") >= BITS - STEP)
            found.append(pairs.join(sizes.where(ready), node, "left_semi"))
            pairs = pairs.join(sizes.where(~ready), node, "left_semi")
        step = STEP
    found.append(pairs)  # all of them are small enough
    forests = [
        p.groupBy("depth", "lo", "hi").applyInPandas(lambda f: _forest(f, budget), "a bigint, b bigint") for p in found
    ]
    out = forests[0]
    for more in forests[1:]:
        out = out.unionByName(more)
    return staged(out.distinct(), "simhash-links")


def _deeper(pairs: DataFrame, step: int, budget: int) -> DataFrame:
    """The pairs ``step`` bits further down; a fingerprint goes with each pair that its node is in and that survives."""
    flips = [x for x in range(1 << step) if int.bit_count(x) <= budget]
    piece = F.expr(f"shiftrightunsigned(bits, {BITS - step} - depth)").bitwiseAND(F.lit((1 << step) - 1))
    here = F.expr(f"case when depth = 0 then 0L else shiftrightunsigned(bits, {BITS} - depth) end")
    mine = F.shiftleft(F.col("here"), step).bitwiseOR(F.col("piece"))
    # Its partner's node is the other one of the pair (the same one in a pair of a node with itself).
    partner = F.when(F.col("here") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    theirs = F.shiftleft(partner, step).bitwiseOR(F.col("piece").bitwiseXOR(F.col("flip")))
    spread = pairs.withColumns({"piece": piece, "here": here}).withColumn("flip", F.explode(F.array(*[F.lit(x).cast("bigint") for x in flips])))
    return spread.select("bits", "depth", mine.alias("mine"), theirs.alias("theirs")).where(
        F.bit_count(F.col("mine").bitwiseXOR(F.col("theirs"))) <= budget
    ).select(
        "bits", (F.col("depth") + step).alias("depth"), F.least("mine", "theirs").alias("lo"), F.greatest("mine", "theirs").alias("hi")
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``), where the root is one node of the component.

    Each round hangs the neighbours of a node onto the smallest of them; rounds are written to the shared folder. The
    number of rounds grows with the logarithm of the longest path.
    """
    stars = staged(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), "star")
    while True:
        # Large star: every larger neighbour of a node goes to the smallest neighbour of that node.
        both = stars.unionByName(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = both.groupBy("node").agg(F.min("root").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = stars.select(F.col("root").alias("node"), F.col("node").alias("up")).join(low, "node").select(
            F.col("up").alias("node"), F.col("low").alias("root")
        ).distinct()
        large = staged(large, "star")
        # Small star: the smaller neighbours of a node, and the node, go to the smallest of them.
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        joined = large.join(least, "node")
        small = joined.select(F.col("root").alias("node"), F.col("low").alias("root")).where("node <> root").unionByName(
            least.select("node", F.col("low").alias("root"))
        ).distinct()
        small = staged(small, "star")
        same = small.exceptAll(stars).isEmpty() and stars.exceptAll(small).isEmpty()
        stars = small
        if same:
            break
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_groups(docs: DataFrame, n: int = 3, budget: int = 2, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """``doc_id, bits, component_id``: the fingerprint and the smallest ``doc_id`` reachable over links."""
    prints = staged(fingerprints(docs, n), "simhash-prints")
    distinct = staged(prints.groupBy("bits").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    member = components(links(distinct.select("bits"), budget, pair_rows)).withColumnRenamed("node", "bits")
    placed = staged(
        distinct.join(member, "bits", "left").select("bits", "doc_id", F.coalesce("root", "bits").alias("root")), "simhash-placed"
    )
    named = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_bits = staged(placed.join(named, "root").select("bits", "component_id"), "simhash-components")
    return prints.join(by_bits, "bits").select("doc_id", "bits", "component_id")


def drop_near(docs: DataFrame, n: int = 3, budget: int = 2) -> DataFrame:
    """One document of each group, that with the smallest ``doc_id``; of rows with that id only one, and one
    without ``doc_id`` only where the group has no other."""
    rows = staged(docs.select(F.struct("*").alias("document")).withColumn("row", F.monotonically_increasing_id()), "near-docs")
    texts = rows.select(F.col("row").alias("doc_id"), F.col("document.text").alias("text"))
    found = near_groups(texts, n, budget).withColumnRenamed("doc_id", "row")
    ids = rows.select("row", F.col("document.doc_id").alias("doc_id")).join(found, "row")
    keep = ids.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("best")
    ).select(F.col("best.row").alias("row"))
    return rows.join(keep, "row", "left_semi").select("document.*")
