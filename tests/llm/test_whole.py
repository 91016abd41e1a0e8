"""Operators do the whole job: nothing is left out because it is rare in a large table, scattered or long."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from math import log, log10
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from wayside.llm import fingerprint, quality, suffix_lm
from wayside.session import shared_dir

ROWS = "doc_id bigint, text string"


def plain_suffix_scores(texts, least, depth=3, divergence=0.01):
    """Every context that training has at least ``least`` times, from dictionaries of counts."""
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    runs = {i: ["<s>", *t.lower().split(), "</s>"] for i, t in texts}
    train = [r for i, r in runs.items() if not held(i)]
    words = Counter(w for r in train for w in r[1:])
    n, once, twice = sum(words.values()), *(sum(c == k for w, c in words.items() if w != "</s>") for k in (1, 2))
    discount = max(0.1, once / max(1, once + 2 * twice))
    follow = defaultdict(Counter)
    for r in train:
        for at in range(1, len(r)):
            for k in range(1, min(depth, at) + 1):
                follow[tuple(r[at - k : at])][r[at]] += 1
    kinds = {}

    def p(context, w):
        if not context:
            return (words[w] - discount) / n if words[w] else discount * len(words) / n
        short = p(context[1:], w)
        if not kinds.get(context):
            return short
        return (follow[context][w] + kinds[context] * short) / (sum(follow[context].values()) + kinds[context])

    for context in sorted(follow, key=len):
        found, total = follow[context], sum(follow[context].values())
        if total < least:
            continue
        gain = 0.0
        for w, c in found.items():
            short = p(context[1:], w)
            gain += c * log((c - 1 + len(found) * short) / (total - 1 + len(found)) / short)
        kinds[context] = len(found) if gain >= divergence * total else 0
    return {i: sum(log10(p(tuple(r[max(0, at - depth) : at]), r[at])) for at in range(1, len(r))) for i, r in runs.items()}


def test_rare_contexts_have_states(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rare = "zig zag zog zug"
    texts = [(i, " ".join(f"w{k}" for k in rng.zipf(1.4, 60) % 900)) for i in range(300)]
    texts += [(1000 + i, f"w1 {rare} w2 w1") for i in range(20)] + [(2000, ""), (2001, "never seen before")]
    docs = spark.createDataFrame(texts, ROWS).repartition(3)
    want = plain_suffix_scores(texts, 2)
    for hot in (suffix_lm.HOT, 0):
        monkeypatch.setattr(suffix_lm, "HOT", hot)
        got = {r["doc_id"]: r["score"] for r in suffix_lm.score_texts(docs).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=0.02) for i in want)


def test_levels_store_no_chunks(spark):
    """What the model writes between levels are counts and answers; documents stay in the lexicon's chunks alone."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k % 7} w{i % 5}" for k in range(40))) for i in range(60)], ROWS).repartition(3)
    files = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("run-*/lm-*"))
    before = files()
    assert suffix_lm.score_texts(docs).count() == 60
    kept = [spark.read.parquet(str(f)) for f in files() - before]
    stored = [f for f in kept if "bucket" in f.columns]
    assert stored and all(f.where("bucket < 0").isEmpty() for f in stored)


def plain_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pipeline_drops_scattered_near_copies(spark):
    rng = np.random.default_rng(11)
    texts = []
    for k in range(40):
        words = [f"t{w}" for w in rng.integers(0, 5000, 120)]
        texts.append(" ".join(words))
        for edits in (1, 2, 4, 30):
            copy = list(words)
            for at in rng.choice(120, edits, replace=False):
                copy[at] = "edited"
            texts.append(" ".join(copy))
    texts += [None, "", "  ", "one", "ONE", "two words"]
    sets = [plain_shingles(t or "") for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), ROWS).repartition(3)
    got = corpus_pipeline.no_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root))


def test_top_word_counts_all_words():
    scattered = " ".join(["top"] * 49 + [f"d{k}" for k in range(51)])
    rng = np.random.default_rng(4)
    words = ["top" if k % 16 == 5 else f"v{rng.integers(0, 60)}" for k in range(480)]
    found = quality.features([scattered, " ".join(words)])[:, quality.FEATURES.index("top_word")]
    assert found == pytest.approx([0.49, max(Counter(words).values()) / 480])


def test_likeness_does_not_jump_with_length():
    rng = np.random.default_rng(9)
    pairs = [(t[:127], t) for t in (rng.integers(97, 123, 129).astype(np.uint32) for _ in range(50))]
    prints = fingerprint.prints([t for p in pairs for t in p])
    assert np.mean([fingerprint.likeness(a, b) for a, b in zip(prints[::2], prints[1::2])]) > 0.85
