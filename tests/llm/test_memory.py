"""What a task holds does not follow what it reads: short batches, small rows, small groups of rows in what is written."""

from __future__ import annotations

import random
from pathlib import Path
from urllib.parse import urlparse

import public_tokenizers
import pyarrow.parquet as pq

from wayside.llm import align, common, phrases, suffix_lm

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def files(frame) -> list[pq.ParquetFile]:
    return [pq.ParquetFile(Path(urlparse(f).path)) for f in frame.inputFiles()]


def texts(spark, n: int, words: int):
    rng = random.Random(n)
    rows = [(i, " ".join(rng.choice(["of", "the", "new", "york", "city", "word%d" % rng.randint(0, 300)]) for _ in range(words)), "en") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1)


def test_align_chunks_are_small(spark, monkeypatch):
    """The chunks of one task are written in several groups of rows, texts come in short batches, and a pair of a document takes less than its two numbers."""
    batches = []
    monkeypatch.setattr(align, "staged", lambda df, *a: (batches.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), common.staged(df, *a))[1])
    monkeypatch.setitem(common.LARGE_ROWS, "parquet.block.size", str(1 << 14))
    monkeypatch.setattr(align, "BLOCK_BYTES", 1 << 14)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    chunks = align._stored(texts(spark, 120, 600), *PATHS, 1 << 14)
    assert batches == ["256"] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert max(f.num_row_groups for f in files(chunks)) >= 4  # one without the options
    rows = chunks.collect()
    pairs = sum(sum(r["n_pairs"]) for r in rows)
    assert len(rows) >= 10 and pairs > 20_000 and sum(len(r["places"]) for r in rows) < 4 * pairs
    assert sum(len(r["doc_id"]) for r in rows) == 120


def test_phrase_blocks_are_small(spark, monkeypatch):
    """Blocks keep a word's number in less than its four bytes, one task's blocks are several groups of rows, and blocks meet their groups in more tasks than other shuffles have."""
    batches = {}
    monkeypatch.setattr(phrases, "staged", lambda df, label, *a: (batches.setdefault(label, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), common.staged(df, label, *a))[1])
    monkeypatch.setitem(common.LARGE_ROWS, "parquet.block.size", str(1 << 14))
    docs = texts(spark, 120, 600)
    monkeypatch.setattr(phrases.occurrences, "__defaults__", (1 << 14,))
    totals, levels, _ = phrases.frequent_phrases(docs)
    assert batches["phrase-blocks"] == "256" and totals.first()["n"] == 120 * 600 and len(levels) == 3
    blocks = common.staged(phrases.occurrences(docs), "phrase-blocks", common.LARGE_ROWS)
    assert max(f.num_row_groups for f in files(blocks)) >= 4  # one without the options
    rows = blocks.collect()
    assert len(rows) >= 10 and sum(len(r["words"]) for r in rows) < 3 * 120 * 600
    known = blocks.selectExpr("block", "1 as place", "1 as id")
    assert phrases.renumbered(blocks, known).rdd.getNumPartitions() > common.width(spark)


def test_suffix_model_takes_few_rows_at_a_time(spark, monkeypatch):
    """Every step, the last one included, runs with short batches, and the session's settings come back."""
    seen = {}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(suffix_lm, "staged", lambda df, label: (seen.setdefault(label, spark.conf.get(key)), common.staged(df, label))[1])
    before = spark.conf.get(key)
    assert suffix_lm.score_texts(texts(spark, 30, 40)).count() == 30
    assert set(seen) == {"lm-counts", "lm-answers", "lm-scores"} and set(seen.values()) == {"64"} and spark.conf.get(key) == before
