"""Benchmark decontamination by winnowing.

Words are runs of ASCII digits, ASCII letters (lower-cased) and other characters from U+0080 on. A window is ``width`` successive words
of a benchmark item; an item with fewer words is one window. A document word inside any occurrence of a window is hit.

Of the k-grams of every window that with the smallest hash is kept, so a document that holds a window keeps the same k-gram in it: no
occurrence is missed. The kept k-grams of documents and items are joined on their hash; a hit is extended to
the windows around it for which that k-gram was kept, which must agree in a 128-bit digest of their words. Items shorter than ``width`` are
searched by k-grams of about half their length, one pass for each such length that the items have.

A bitmap of ``2 ** BITMAP`` bits, whatever the number of items, spares documents most k-grams that no item has; it only thins the join's input.
Windows with the same items share a set of items, so a common window costs each document one row and not one for each item.

Edge cases: null and empty texts have no words, are not hit and match nothing; an item without words has no window; documents of the
same id (or without one) each come out; extra columns are ignored; rows of the same ``item_id`` are one item; a null ``item_id``
matches, but is not listed (``items`` skips it); without items every document is clean; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from wayside.llm.align import blocks
from wayside.llm.common import staged, text_of

WIDTH = 10
#: Bits of the bitmap, as a power of two.
BITMAP = 23
#: Bytes of text handled at once; a longer text is handled alone.
BLOCK = 1 << 20
#: Every byte as it counts in words: digits, lower-case letters and bytes of other characters stay, the rest becomes a space.
LETTERS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def parts(length: int) -> tuple[int, int]:
    """Words of a k-gram and k-grams of a window of that many words."""
    k = (length + 2) // 2
    return k, length - k + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _tail(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse."""
    odd = 0x5851F42D4C957F2D
    up, down = (np.full(n + 1, v, np.uint64) for v in (odd, pow(odd, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """The words of some texts: hash and place of each, and how many each text has."""

    def __init__(self, texts: list[str]):
        coded = [t.encode("utf-8", "replace").translate(LETTERS) + b" " for t in texts]
        self.data = b"".join(coded)
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.concatenate(([False], raw != 0x20))
        edges = np.flatnonzero(inside[1:] != inside[:-1])  # every text ends in a space, so they come in twos
        self.starts, self.ends = edges[::2], edges[1::2]
        # Sums of byte values times powers, taken back to the word's first byte.
        up, down = _tail(len(raw))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(raw.astype(np.uint64) + _MIX[0]) * up[: len(raw)])))
        self.hashes = _mixed((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.bounds = np.searchsorted(self.starts, np.cumsum([0, *map(len, coded)]))

    def digest(self, at: int, length: int) -> bytes:
        """128 bits for the words from ``at`` on."""
        return xxhash.xxh3_128_digest(b" ".join(self.data[self.starts[at] : self.ends[at + length - 1]].split()))


def winnowed(hashes: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and kept k-gram hash of every window of ``length`` words within the bounds."""
    k, n = parts(length)
    many = len(hashes) - length + 1
    if many <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        grams = _mixed(grams + hashes[i : len(grams) + i] + _MIX[0])
    least = grams[:many].copy()
    for i in range(1, n):
        np.minimum(least, grams[i : many + i], out=least)
    # A window must not reach over the end of its text.
    room = np.zeros(len(hashes), bool)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        room[low : max(low, high - length + 1)] = True
    at = np.flatnonzero(room[:many])
    return at, least[at]


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item_id, length, gram, window``: the windows of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, BLOCK):
            words = Words(texts)
            sizes = np.diff(words.bounds)
            rows: list[tuple] = []
            for length in sorted(set(np.minimum(sizes, width).tolist()) - {0}):
                own = sizes >= width if length == width else sizes == length
                at, grams = winnowed(words.hashes, words.bounds, length)
                owner = np.searchsorted(words.bounds, at, side="right") - 1
                fits = own[owner]
                for place, who, gram in zip(at[fits].tolist(), owner[fits].tolist(), grams[fits].view(np.int64).tolist()):
                    rows.append((ids[who], length, gram, words.digest(place, length)))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                names=["item_id", "length", "gram", "window"],
            )

    return items.select(F.col("item_id").cast("bigint"), text_of().alias("text")).mapInArrow(
        run, "item_id bigint, length int, gram bigint, window binary"
    )


def bitmap(grams: DataFrame) -> np.ndarray:
    """Bits of the hashes that occur; of a fixed size, however many they are."""
    slot = f"shiftrightunsigned(gram, {64 - BITMAP})"
    found = grams.select(F.expr(f"shiftrightunsigned({slot}, 6)").alias("at"), F.expr(f"shiftleft(1L, cast({slot} & 63 as int))").alias("bit"))
    rows = found.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (BITMAP - 6), np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def searched(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """``row, doc_id, n_words, found`` with the windows of each document whose kept k-gram may be an item's."""
    shift = np.uint64(64 - BITMAP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches, BLOCK):
            words = Words(texts)
            found: list[list[dict]] = [[] for _ in ids]
            for length in lengths:
                at, grams = winnowed(words.hashes, words.bounds, length)
                maybe = bits[(grams >> shift).astype(np.int64)]
                at, grams = at[maybe], grams[maybe]
                owner = np.searchsorted(words.bounds, at, side="right") - 1
                for place, who, gram in zip(at.tolist(), owner.tolist(), grams.view(np.int64).tolist()):
                    found[who].append(
                        {"length": length, "start": place - int(words.bounds[who]), "gram": gram, "window": words.digest(place, length)}
                    )
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.diff(words.bounds), pa.int64()), pa.array(found, FOUND)],
                names=["doc_id", "n_words", "found"],
            )

    rows = docs.select("doc_id", text_of().alias("text")).mapInArrow(
        run, "doc_id bigint, n_words bigint, found array<struct<length: int, start: bigint, gram: bigint, window: binary>>"
    )
    return rows.withColumn("row", F.monotonically_increasing_id())


FOUND = pa.list_(pa.struct([("length", pa.int32()), ("start", pa.int64()), ("gram", pa.int64()), ("window", pa.binary())]))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is found: documents ``row, doc_id, n_words``, hits ``row, start, length, items`` and sets of items ``items, item_id``."""
    item_windows = staged(windows(items, width), "leak-windows")
    key = ["length", "gram", "window"]
    # A set of items by its size and two sums of hashes: no list of a common window's items is gathered.
    which = item_windows.select(*key, "item_id").distinct()
    known = staged(
        which.groupBy(*key).agg(
            F.struct(
                F.count("*").alias("size"),
                F.bit_xor(F.xxhash64("item_id")).alias("low"),
                F.bit_xor(F.xxhash64(F.lit(1), "item_id")).alias("high"),
            ).alias("items")
        ),
        "leak-known",
    )
    first = known.groupBy("items").agg(F.min(F.struct(*key)).alias("first")).select("items", "first.*")
    sets = staged(which.join(first, key).select("items", "item_id"), "leak-sets")
    lengths = [r["length"] for r in known.select("length").distinct().collect()]
    found = staged(searched(docs, sorted(lengths), bitmap(known)), "leak-found")
    spread = found.where(F.size("found") > 0).select("row", F.explode("found").alias("hit")).select("row", "hit.*")
    hits = staged(spread.join(known, key).select("row", "start", "length", "items"), "leak-hits")
    return found.select("row", "doc_id", "n_words"), hits, sets


def spans(hits: DataFrame) -> DataFrame:
    """``row, start, end`` of the hit stretches of words, overlapping windows in one."""
    order = Window.partitionBy("row").orderBy("start", "end")
    ends = hits.select("row", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = ends.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("bigint"))
    return (
        new.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("span")
    )


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items``: hit words, their stretches, and the items that have windows in the document."""
    rows, hits, sets = contamination(docs, items, width)
    hit = spans(hits).groupBy("row").agg(
        F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")
    )
    listed = hits.select("row", "items").distinct().join(sets, "items").groupBy("row").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    return rows.join(hit, "row", "left").join(listed, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_hits(docs: DataFrame, items: DataFrame, most: float = 0.0, width: int = WIDTH) -> DataFrame:
    """``doc_id`` and figures of the documents of whose words at most the share ``most`` is hit."""
    return contaminated(docs, items, width).where(F.col("n_hit") <= F.lit(most) * F.col("n_words"))
