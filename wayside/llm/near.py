"""Near-deduplication by the Jaccard similarity of word shingles.

Two texts are linked if their sets of five-word shingles (64-bit hashes of lower-case words) have a similarity of at least
``SIMILARITY``; every link is checked on the two texts. Texts with equal sets are one from the start. The first candidates come from the SimHash
trie walk of ``simhash``, over five-word shingles and ``BUDGET`` bits. At a similarity of 0.8 fingerprints differ in more bits than a trie can
prune by, so the pairs beyond the budget come from MinHash: ``BANDS`` keys of ``ROWS`` minima each, of which a pair of similarity 0.8 shares one with
probability 1 - (1 - 0.8^5)^24 = 0.99993.

Texts that share keys are told apart by their shingles, ordered by rarity among them. A text that has more than a fifth of its shingles for
itself has no links. Each other one is compared with one text of its keys, that with the fewest shingles of its own, which is nearest to what a group has in
common. What then still shares a key across components is joined exactly, however many share a key: two texts of different components become a pair if they share a
shingle of their first fifth at places that leave enough for the similarity. Edited copies begin with their own shingles, so few unlinked pairs of a
large group pass these bounds.

Edge cases: a null text counts as empty; texts without words are alike; texts of fewer words than a shingle are one
shingle; rows with the same id each count; extra columns stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from wayside.llm.common import staged, text_of
from wayside.llm.simhash import components, fingerprints, links as print_links

WORDS, SIMILARITY = 5, 0.8
#: Bits in which fingerprints of candidates may differ.
BUDGET = 3
BANDS, ROWS, SEED = 24, 5, 42
#: Shingles hashed together.
BLOCK = 1 << 18


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Hashes of the shingles of a text, in order; at least one."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    found = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    wide = min(n, len(words))
    out = np.full(len(words) - wide + 1, wide, np.uint64)
    for at in range(wide):
        out = (out ^ found[at : len(words) - wide + 1 + at]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct, sorted hashes."""
    both = np.sort(np.concatenate((a, b)))
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of keys per set."""
    flat = np.concatenate(sets)
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    seeds = np.random.default_rng(SEED).integers(0, 1 << 32, (BANDS * ROWS, 2), dtype=np.uint32)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for k, (factor, shift) in enumerate(seeds):
        x = (flat ^ shift) * (factor | np.uint32(1))
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        band = keys[:, k // ROWS]
        band ^= np.minimum.reduceat(x, starts).astype(np.uint64) + np.uint64(k)
        band *= np.uint64(0xBF58476D1CE4E5B9)
        band ^= band >> np.uint64(31)
    return keys


def _hashed(rows: DataFrame, make, schema: str, names: list[str]) -> DataFrame:
    """Apply ``make`` to blocks of row numbers and their sets of shingles; it returns Arrow arrays."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, size = [], [], 0
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(row)
                sets.append(np.unique(shingles(text.as_py())))
                size += len(sets[-1])
                if size > BLOCK:
                    yield pa.RecordBatch.from_arrays(make(np.array(ids, np.int64), sets), names=names)
                    ids, sets, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays(make(np.array(ids, np.int64), sets), names=names)

    return rows.select("row", text_of().alias("text")).mapInArrow(compute, schema)


def keyed(rows: DataFrame) -> DataFrame:
    """``row, digest, keys``: 128 bits of the set of each row, and its keys."""

    def make(ids: np.ndarray, sets: list[np.ndarray]) -> list[pa.Array]:
        keys = band_keys(sets).view(np.int64)
        digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
        return [pa.array(ids), digests, pa.array(list(keys), pa.list_(pa.int64()))]

    return _hashed(rows, make, "row bigint, digest binary, keys array<bigint>", ["row", "digest", "keys"])


def checked(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` of rows whose texts are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, None
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (0, 1))
            near = []
            for k in range(len(a)):
                if b[k] != at:
                    at, known = b[k], np.unique(shingles(batch.column(3)[k].as_py()))
                if similarity(np.unique(shingles(batch.column(2)[k].as_py())), known) >= least:
                    near.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[k] for k in near], pa.int64()), pa.array([b[k] for k in near], pa.int64())], names=["a", "b"]
            )

    text = lambda side: rows.select(F.col("row").alias(side), text_of().alias(f"text_{side}"))
    both = pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
    return staged(both.mapInArrow(compare, "a bigint, b bigint"), "near-links")


def print_pairs(rows: DataFrame) -> DataFrame:
    """Candidates ``a, b`` by fingerprint: rows of equal ones with the smallest of them, and the smallest rows along the links of the trie walk."""
    prints = staged(fingerprints(rows.select(F.col("row").alias("doc_id"), "text"), WORDS).withColumnRenamed("doc_id", "row"), "near-prints")
    leads = staged(prints.groupBy("bits").agg(F.min("row").alias("lead")), "near-prints")
    equal = prints.join(leads, "bits").where("row <> lead").select(F.col("row").alias("a"), F.col("lead").alias("b"))
    ends = [leads.select(F.col("bits").alias(end), F.col("lead").alias(f"lead_{end}")) for end in "ab"]
    linked = print_links(leads.select("bits"), BUDGET).join(ends[0], "a").join(ends[1], "b")
    return equal.unionByName(linked.select(F.greatest("lead_a", "lead_b").alias("a"), F.least("lead_a", "lead_b").alias("b")))


def _rooted(shared: DataFrame, links: DataFrame) -> DataFrame:
    """``key, row, root`` of the rows that share keys."""
    member = staged(components(links), "near-members").select(F.col("node").alias("row"), "root")
    return staged(shared.join(member, "row", "left").select("key", "row", F.coalesce("root", "row").alias("root")), "near-rooted")


def _one_each(shared: DataFrame, alone: DataFrame) -> DataFrame:
    """A pair ``a, b`` for every row: with the row of its keys that has the smallest share of shingles of its own (``row, share``)."""
    led = shared.join(alone, "row")
    end = F.struct("share", "row")
    first = led.groupBy("key").agg(F.min(end).alias("first"))
    second = led.join(first, "key").where(F.col("row") != F.col("first.row")).groupBy("key").agg(F.min(end).alias("second"))
    leads = staged(first.join(second, "key"), "near-leads")
    named = shared.join(leads, "key").select("row", F.when(F.col("first.row") != F.col("row"), F.col("first")).otherwise(F.col("second")).alias("lead"))
    best = named.groupBy("row").agg(F.min("lead").alias("lead"))
    pairs = best.select(F.greatest("row", "lead.row").alias("a"), F.least("row", "lead.row").alias("b"))
    return pairs.distinct()


def first_shingles(rows: DataFrame, least: float) -> DataFrame:
    """``row, n, shingle, place``: of each row, among its shingles by rarity, the shared ones of which a similar text must have one."""

    def make(ids: np.ndarray, sets: list[np.ndarray]) -> list[pa.Array]:
        sizes = np.array([len(s) for s in sets])
        return [pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))]

    each = _hashed(rows, make, "row bigint, n bigint, shingle bigint", ["row", "n", "shingle"])
    often = each.withColumn("often", F.count("*").over(Window.partitionBy("shingle"))).where("often > 1")
    own = Window.partitionBy("row")
    # A row's own shingles come first, then those that it shares.
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "shingle")) - 1
    ranked = often.withColumn("place", place).where(F.col("place") < F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
    return ranked.select("row", "n", "shingle", "place")


def open_pairs(open_: DataFrame, first: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` of open rows (``row, root``) of different components: all that are similar, and others that the bounds let pass."""
    known = staged(first.join(open_, "row"), "near-sides")
    a, b = (known.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("row", "root", "n", "place")]) for side in "ab")
    shared = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    enough = F.ceil(F.lit(least / (1 + least)) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    close = (F.col("n_a") >= F.lit(least) * F.col("n_b")) & (F.col("n_b") >= F.lit(least) * F.col("n_a"))
    pairs = a.join(b, "shingle").where((F.col("row_a") > F.col("row_b")) & (F.col("root_a") != F.col("root_b")) & close & (shared >= enough))
    return staged(pairs.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")).distinct(), "near-pairs")


def near_links(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links ``a, b`` between rows (``row, text``): equal sets, and pairs whose texts were checked."""
    sets = staged(keyed(rows), "near-sets")
    alike = sets.groupBy("digest").agg(F.min("row").alias("b"), F.count("*").alias("n"))
    same = sets.select("row", "digest").join(staged(alike.where("n > 1"), "near-alike"), "digest").where("row <> b").select(F.col("row").alias("a"), "b")
    links = staged(same, "near-same")
    single = sets.join(links.select(F.col("a").alias("row")), "row", "left_anti")
    keys = staged(single.select("row", F.explode(F.array_distinct("keys")).alias("key")), "near-keys")
    several = staged(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-several")
    shared = staged(keys.join(several, "key", "left_semi").select("key", "row"), "near-shared")
    texts = rows.join(shared.select("row").distinct(), "row", "left_semi")
    first = staged(first_shingles(texts, least), "near-first")
    alone = staged(first.groupBy("row").agg((F.min("place") / F.first("n")).alias("share")), "near-alone")
    shared = staged(shared.join(alone.select("row"), "row", "left_semi").select("key", "row"), "near-shared")
    by_print = print_pairs(rows.join(single.select("row"), "row", "left_semi"))
    found = checked(staged(by_print.unionByName(_one_each(shared, alone)).distinct(), "near-pairs"), rows, least)
    rooted = _rooted(shared, found)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    open_ = rooted.join(mixed.select("key"), "key", "left_semi").select("row", "root").distinct()
    rest = checked(open_pairs(staged(open_, "near-open"), first, least), rows, least)
    return links.unionByName(found).unionByName(rest)


def drop_similar(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each group of linked texts, that with the smallest ``doc_id``; of rows with that id only one, and
    one without ``doc_id`` only where the group has no other."""
    whole = docs.select(F.struct("*").alias("document")).withColumn("row", F.monotonically_increasing_id())
    rows = staged(whole, "near-docs")
    ids = rows.select("row", F.col("document.doc_id").alias("doc_id"))
    member = components(near_links(rows.select("row", F.col("document.text").alias("text")), least)).select(F.col("node").alias("row"), "root")
    grouped = staged(ids.join(member, "row"), "near-groups")
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("best"))
    gone = grouped.join(best.select(F.col("best.row").alias("row")), "row", "left_anti").select("row")
    return rows.join(gone, "row", "left_anti").select("document.*")
