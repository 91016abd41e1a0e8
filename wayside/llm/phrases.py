"""Phrases whose words stand together more often than apart, mined set by set.

Texts are cut into pieces at marks and line ends, pieces into words at spaces and tabs, A-Z lower-cased; everything counts within a language
(null: ``und``). The occurrence relation of words, sorted by piece and position, is persisted in blocks: one row per block and language
with the words' numbers in order, 0 between pieces, compressed.

Level by level, the relation of phrases of one length is merge-joined with itself by piece and adjacent position (two sorted columns, one
pass per block), occurrences are grouped and counted, and groups seen less than ``least`` times drop out: what stays is numbered in the same
shuffle and goes back to the blocks, which know their frequent phrases before they extend them by a word. The last length is only counted. A block sends each of its distinct phrases once, so a
hot phrase is one row per block; no list of phrases is broadcast.

A phrase is cut after each of its words; with ``a`` its count and ``l, r`` those of the two parts, its score is the least of
``floor(1000000 a a / (l r))`` (exact decimals). Phrases inside a longer one that makes up ``share`` percent of their count drop out.

Edge cases: null and empty texts have no words; a word is never cut, however long; a language is whatever the column holds; rows of the
same id count each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wayside.llm.common import LARGE_ROWS, SHORT_BATCHES, settings, staged, text_of, width
from wayside.llm.lexicon import pack, unpack

LEAST, LONGEST, SHARE, TOP = 10, 3, 50, 2000
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 12 << 20
#: Marks that end a piece become a byte that no text holds.
MARKS = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))

#: A task holds one block at a time, in the reader and in what goes to Python.
ONE_BLOCK = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "4"}

#: Buckets of a hash in which groups are numbered, times the partitions of a shuffle.
BUCKETS = 64
#: Partitions in which groups of all blocks are sorted and blocks meet their groups, times those of other shuffles.
PARTS = 4
#: Shuffles go as soon as the step that made them has written its result.
SWEPT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

BLOCK = "block bigint, lang string, words binary, listed array<string>, often array<bigint>"


class _Numbers(dict):
    """Numbers words as they come, from 1."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def pieces(text: str) -> list[bytes]:
    """The words of a text, with the byte 0xFF at the end of every piece."""
    return text.encode("utf-8", "replace").lower().translate(MARKS).replace(b"\xff", b" \xff ").split()


def occurrences(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The words of every block in order (numbers of ``listed``, from 1), and how often the block has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial, size = TaskContext.get().partitionId() << 32, 0
        open_: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}

        def rows():
            nonlocal serial
            for lang, (numbers, runs) in open_.items():
                words = np.concatenate(runs)
                words[words == numbers[b"\xff"]] = 0
                listed = [w.decode() if w != b"\xff" else "" for w in numbers]
                often = np.bincount(words, minlength=len(listed) + 1)[1:]
                columns = [serial], [lang], [pack(words)], [listed], [often]
                types = pa.int64(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["block", "lang", "words", "listed", "often"])
                serial += 1

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py()
                if size and size + len(text) > block_bytes:
                    yield from rows()
                    open_, size = {}, 0
                found = pieces(text)
                numbers, runs = open_.setdefault(lang, (_Numbers({b"\xff": 1}), []))
                runs.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                runs.append(np.array([numbers[b"\xff"]], np.int32))
                size += len(text)
        yield from rows()

    return docs.select(text_of().alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(run, BLOCK)


def counted(groups: DataFrame, least: int, *key: str) -> DataFrame:
    """The groups of each block that reach ``least`` over all blocks, with a number ``id`` of the group from 1 on, nearly dense; ``first`` marks one
    row of each group, which alone has its count ``a``. One shuffle, by buckets of a hash, counts, semi-joins and numbers, without a global sort."""
    buckets = BUCKETS * width(groups.sparkSession)
    at = groups.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets))).repartition(PARTS * width(groups.sparkSession), "bucket")
    kept = at.withColumn("a", F.sum("n").over(Window.partitionBy("bucket", *key))).where(F.col("a") >= least)
    turn = Window.partitionBy("bucket").orderBy(*key)
    number = ((F.dense_rank().over(turn) - 1) * buckets + F.col("bucket") + 1).cast("int")
    kept = kept.withColumns({"id": number, "first": F.row_number().over(turn) == F.rank().over(turn)})
    return kept.withColumn("a", F.when(F.col("first"), F.col("a"))).drop("bucket", "n")


def totalled(groups: DataFrame, least: int, *key: str) -> DataFrame:
    """The groups that reach ``least`` over all blocks, with their count ``a``; tasks add up their blocks before rows move."""
    return groups.groupBy(*key).agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def renumbered(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """``block, words``: blocks with the numbers of frequent words; other words become 0, like the ends of pieces."""
    schema = "block bigint, words binary"

    def finish(_, block: pa.Table, known: pa.Table) -> pa.Table:
        own = unpack(block.column("words")[0].as_py(), np.int32)[0]
        number = np.zeros(int(own.max(initial=0)) + 2, np.int32)
        number[known.column("place").to_numpy()] = known.column("id").to_numpy()
        return pa.Table.from_arrays([block.column("block"), pa.array([pack(number[own])], pa.binary())], names=["block", "words"])

    return _met(blocks.select("block", "words"), words).applyInArrow(finish, schema)


def _met(blocks: DataFrame, groups: DataFrame):
    """Every block together with its groups."""
    parts = PARTS * width(blocks.sparkSession)
    groups = groups.withColumnRenamed("block", "of")
    return blocks.repartition(parts, "block").groupBy("block").cogroup(groups.repartition(parts, "of").groupBy("of"))


def _adjacent(phrase: np.ndarray, words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a phrase and the one that starts a word later are both frequent: place, phrase there, and the word that extends it."""
    at = np.flatnonzero((phrase[:-1] > 0) & (phrase[1:] > 0))
    return at, phrase[at], words[at + length]


def extended(relation: DataFrame, length: int) -> DataFrame:
    """``block, left, word, n``: the distinct phrases of ``length + 1`` words of every block, each as a frequent phrase and a word."""
    schema = "block bigint, left int, word int, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, phrase = (unpack(batch.column(c)[k].as_py(), np.int32)[0] for c in (1, 2))
                _, left, word = _adjacent(phrase, words, length)
                keys, n = np.unique((left.astype(np.int64) << 32) | word, return_counts=True)
                for at in range(0, len(keys), 1 << 16):
                    part = keys[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(part), batch.column(0)[k].as_py(), np.int64)), pa.array((part >> 32).astype(np.int32)),
                            pa.array((part & 0xFFFFFFFF).astype(np.int32)), pa.array(n[at : at + (1 << 16)].astype(np.int64)),
                        ],
                        names=["block", "left", "word", "n"],
                    )

    return relation.select("block", "words", "phrase").mapInArrow(run, schema)


def matched(relation: DataFrame, frequent: DataFrame, length: int) -> DataFrame:
    """``block, words, phrase``: the relation with the numbers of the frequent phrases of ``length + 1`` words where they start."""
    schema = "block bigint, words binary, phrase binary"

    def finish(_, block: pa.Table, known: pa.Table) -> pa.Table:
        words, phrase = (unpack(block.column(c)[0].as_py(), np.int32)[0] for c in ("words", "phrase"))
        out = np.zeros(len(words), np.int32)
        if len(known):
            at, left, word = _adjacent(phrase, words, length)
            keys = (known.column("left").to_numpy().astype(np.int64) << 32) | known.column("word").to_numpy()
            order = np.argsort(keys)
            keys, number = keys[order], known.column("id").to_numpy()[order]
            wanted = (left.astype(np.int64) << 32) | word
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            out[at] = np.where(keys[place] == wanted, number[place], 0)
        return pa.Table.from_arrays([block.column("block"), block.column("words"), pa.array([pack(out)], pa.binary())], names=["block", "words", "phrase"])

    return _met(relation.select("block", "words", "phrase"), frequent).applyInArrow(finish, schema)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Frequent words and phrases: per level ``words`` (numbers) and ``a``; the texts of numbers; all words per language."""
    with settings(docs.sparkSession, SHORT_BATCHES):
        blocks = staged(occurrences(docs), "phrase-blocks", LARGE_ROWS)
    totals = blocks.groupBy("lang").agg(F.sum(F.aggregate("often", F.lit(0).cast("bigint"), lambda n, one: n + one)).alias("n"))
    places = blocks.select("block", "lang", F.posexplode(F.arrays_zip("listed", "often")).alias("place", "item")).where("item.often > 0").select(
        "block", "lang", (F.col("place") + 1).alias("place"), F.col("item.listed").alias("word"), F.col("item.often").alias("n")
    )
    known = counted(places, least, "lang", "word")
    known = staged(known.withColumns({c: F.when(F.col("first"), F.col(c)) for c in ("lang", "word")}), "phrase-words")
    names = known.where("first").select("id", "lang", F.col("word").alias("name"), "a")
    relation = staged(renumbered(blocks, known.select("block", "place", "id")), "phrase-relation", LARGE_ROWS).withColumn("phrase", F.col("words"))
    numbers = names.select("id", F.array("id").alias("words"), "a")
    levels = [numbers.select("words", "a")]
    for length in range(1, longest):
        last = length + 1 == longest
        with settings(relation.sparkSession, ONE_BLOCK):
            rows = extended(relation, length)
            found = staged(totalled(rows, least, "left", "word") if last else counted(rows, least, "left", "word"), "phrase-counts")
        groups = found if last else found.where("first")
        spelt = groups.join(numbers.select(F.col("id").alias("left"), "words"), "left")
        spelt = staged(spelt.select(*[c for c in ("id",) if not last], F.concat("words", F.array("word")).alias("words"), "a"), "phrase-level")
        levels.append(spelt.select("words", "a"))
        if not last:
            numbers = spelt
            relation = staged(matched(relation, found.select("block", "left", "word", "id"), length), "phrase-relation", LARGE_ROWS)
    return totals, levels, names.select("id", "lang", "name")


def scored(levels: list[DataFrame]) -> DataFrame:
    """``words, a, l, r, score`` of the candidates, with their lowest-scoring cut."""
    out = None
    for length in range(2, len(levels) + 1):
        here = levels[length - 1]
        cuts = None
        for k in range(1, length):
            left = levels[k - 1].select(F.col("words").alias("head"), F.col("a").alias("l"))
            right = levels[length - k - 1].select(F.col("words").alias("tail"), F.col("a").alias("r"))
            cut = here.withColumns({"head": F.slice("words", 1, k), "tail": F.slice("words", k + 1, length)}).join(left, "head").join(right, "tail")
            score = F.expr("cast(1000000 as decimal(7,0)) * (cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
            cut = cut.select("words", "a", F.struct(score.alias("score"), F.lit(k).alias("k"), "l", "r").alias("cut"))
            cuts = cut if cuts is None else cuts.unionByName(cut)
        best = cuts.groupBy("words", "a").agg(F.min("cut").alias("cut")).select("words", "a", "cut.l", "cut.r", "cut.score")
        out = best if out is None else out.unionByName(best)
    return out


def covered(levels: list[DataFrame]) -> DataFrame:
    """``words, within``: candidates inside a longer one, and the highest count of such."""
    out = None
    for length in range(3, len(levels) + 1):
        parts = [F.slice("words", at + 1, size) for size in range(2, length) for at in range(length - size + 1)]
        rows = levels[length - 1].select(F.explode(F.array_distinct(F.array(*parts))).alias("words"), F.col("a").alias("within"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("words").agg(F.max("within").alias("within")) if out is not None else None


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, share: int = SHARE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases."""
    with settings(docs.sparkSession, SWEPT):
        totals, levels, names = frequent_phrases(docs, least, longest)
        found = staged(scored(levels), "phrase-scores")
        inside = covered(levels)
        if inside is not None:
            held = found.join(inside, "words", "left")
            found = held.where(F.coalesce(100 * F.col("within") < share * F.col("a"), F.lit(True))).drop("within")
        rows = staged(found.withColumn("row", F.monotonically_increasing_id()), "phrase-rows")
    spelt = (
        rows.select("row", F.posexplode("words").alias("at", "id")).join(names, "id")
        .groupBy("row").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "name"))).alias("parts"))
        .select("row", "lang", F.array_join(F.col("parts.name"), " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.join(spelt, "row").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint"), "phrase", "a", "l", "r", "n", "score")
