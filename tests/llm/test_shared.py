"""Alignment, decontamination, phrases and near duplicates against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.test_operators import PROSE, SCHEMA, TEXTS
from wayside.llm import align, decontaminate, exact, mixing, near, phrases, simhash

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = ["a  b\tc\n d ", "  lead and trail  ", "▁x", "fiﬁ ½", "<|endoftext|> <s> </s>", "\U0001f600\U0001f600 " * 40, "x" * 3000, "don't  DON'T 's"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [t if t is None else t[:4000] for t in TEXTS] + MORE
    rows = [(i, t, None if i % 5 == 0 else "en", f"s{i % 4}", None, "f", i, "b") for i, t in enumerate(texts)]
    rows += [(12, PROSE, "en", "s0", 1, None, None, None), (None, PROSE, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_groups(text, first, second):
    """Groups of ids of both tokenizers, by plain comparison of ends; none where bytes differ."""
    letters = align.byte_letters()
    a = first.encode(" " + text, add_special_tokens=False).ids
    b = second.encode(text)
    sizes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
    sizes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(second.id_to_piece, b))]
    if not text or not b"".join(sizes_a) == (" " + text).encode() == b"".join(sizes_b):
        return []
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in (sizes_a, sizes_b)]
    shared, groups = set(ends[0]) & set(ends[1]), [([], [])]
    for side, ids in enumerate((a, b)):
        at = 0
        for i, end in zip(ids, ends[side]):
            groups[at][side].append(i)
            if end in shared:
                at += 1
                if side == 0:
                    groups.append(([], []))
    return groups[:-1]


def test_alignment(docs):
    first, second = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    first.encode_special_tokens = True
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = [plain_groups(t, first, second) for _, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    held = Counter(p for found in links for p in found)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    want = []
    for (doc_id, _), g, found in zip(rows, groups, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        want.append((
            doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(found.values()),
            sum(n for p, n in found.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in found.items()),
            hashlib.sha256(shown.encode()).hexdigest() if g else "",
        ))
    for chunk in (align.CHUNK_BYTES, 1):  # one chunk a task, or one a block
        got = [tuple(r) for r in align.alignment(docs, *PATHS, chunk_bytes=chunk).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    whole = {r["doc_id"]: r["groups"] for r in align.align(docs.where("doc_id > 12"), *PATHS).collect()}
    for (doc_id, text), g in zip(rows, groups):
        if doc_id in whole:
            assert [(x["a"], x["b"]) for x in whole[doc_id]] == g
            assert not g or (whole[doc_id][0]["start"], whole[doc_id][-1]["end"]) == (0, len(text.encode()) + 1)
    counts = {(r["a"], r["b"]): r["count"] for r in align.link_counts(docs, *PATHS).collect()}
    assert counts == dict(held)


def test_cuts_are_the_shared_ends():
    rng = np.random.default_rng(1)
    for _ in range(300):
        ends = np.arange(1, rng.integers(1, 200) + 1)
        share = rng.choice([0.01, 0.1, 0.5, 0.9], 2)
        a, b = (ends[(rng.random(len(ends)) < s) | (ends == ends[-1])] for s in share)
        assert a[align.shared_cuts(a, b, np.array([len(a) - 1]))].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_wide_groups_count_alike(monkeypatch):
    first, second = align.ByteTokens(PATHS[0]), align.PieceTokens(PATHS[1])
    found = align.aligned([t or "" for t in TEXTS[:12]] + MORE, first, second)
    keys, times = align._links(found, first.size, second.size)
    for wide in (0, 1, 3):
        monkeypatch.setattr(align, "WIDE", wide)
        again = align._links(found, first.size, second.size)
        assert again[0].tolist() == keys.tolist() and again[1].tolist() == times.tolist()


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_contamination(spark, docs, nothing):
    rng = random.Random(3)
    letters = [f"w{i}" for i in range(30)]
    items = [" ".join(rng.choice(letters) for _ in range(n)) for n in (25, 12, 10, 9, 4, 2, 1, 0, 14)] + [PROSE, "é Ü 42", None]
    items.append("start " + " ".join(items[0].split()[3:20]))
    texts = [" ".join(rng.choice(letters) for _ in range(200)) for _ in range(6)]
    for k in (0, 1, 2, 3, 4, 8):
        texts.append(f"before, {items[k].upper()}! after {items[k][5:]} and-again {items[k]}")
    texts += [None, "", "-- !", items[0], "É Ü 42 é Ü 42", " ".join(items[0].split()[2:13])]
    table = spark.createDataFrame([(i % 7 if i else None, t) for i, t in enumerate(items)], "item_id bigint, text string")
    frame = docs.select("doc_id", "text", F.lit(1).alias("row"), F.lit("x").alias("window")).unionByName(
        spark.createDataFrame([(1000 + i, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, row int, window string")
    )
    windows = defaultdict(set)
    for item, text in ((r["item_id"], r["text"]) for r in table.collect()):
        words = WORDS.findall(ascii_lower(text))
        for i in range(len(words) - min(10, len(words)) + 1 if words else 0):
            windows[tuple(words[i : i + 10])].add(item)
    want = []
    for doc_id, text in ((r["doc_id"], r["text"]) for r in frame.collect()):
        words, hit, found = WORDS.findall(ascii_lower(text)), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])]
        spans = [(min(g), max(g) + 1) for g in _runs(sorted(hit))]
        want.append((doc_id, len(words), len(hit), spans, sorted(str(i) for i in found if i is not None)))
    got = []
    for r in decontaminate.contaminated(frame, table).collect():
        joined = []  # spans that only touch count as two in the result
        for s in r["spans"]:
            if joined and joined[-1][1] == s["start"]:
                joined[-1] = (joined[-1][0], s["end"])
            else:
                joined.append((s["start"], s["end"]))
        got.append((r["doc_id"], r["n_words"], r["n_hit"], joined, r["items"]))
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[2] > 0 for w in want) > 8
    assert decontaminate.contaminated(nothing, table).count() == 0
    assert decontaminate.contaminated(frame, table.limit(0)).where("n_hit > 0 or size(items) > 0").count() == 0
    assert decontaminate.drop_hits(frame, table).count() == sum(w[2] == 0 for w in want)


def _runs(sorted_places):
    out = []
    for p in sorted_places:
        if out and out[-1][-1] == p - 1:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def plain_phrases(rows, least, longest, share, top):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", ascii_lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        listed = []
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in chosen.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        for p, a in chosen.items():
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p in inside and 100 * inside[p] >= share * a:
                continue
            listed.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


@pytest.mark.parametrize("longest, top", [(3, 2000), (2, 5), (4, 40)])
def test_phrases(spark, nothing, longest, top):
    rng = random.Random(longest)
    words = ["the", "The", "of", "new", "york", "city", "é", "b c", "d-e", "x" * 50, "日本"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", "\n", " \t"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "de", None, "und"]), None, None, "f", 1, "w") for i, t in enumerate(texts)]
    rows += [(7, "of the city " * 900, "en", None, None, "f", 1, "w"), (None, None, "fr", None, None, "f", 1, "w"), (8, "", "en", None, None, "f", 1, "w")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = phrases.collocations(frame, top=top, longest=longest)
    want = plain_phrases([(r[2] or "und", r[1]) for r in rows], 10, longest, 50, top)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 10
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    if longest == 3:
        assert phrases.collocations(nothing).count() == 0


def test_phrase_groups_move_once(spark):
    """Counting, dropping and numbering the groups of blocks takes one shuffle, and the last length, which is only counted, adds up before it."""
    rows = [(block, left, word, 1 + (left + word) % 3) for block in range(6) for left in range(1, 41) for word in range(1, 8) if (block * left + word) % 5]
    groups = spark.createDataFrame(rows, "block bigint, left int, word int, n bigint")
    sums = Counter()
    for _, left, word, n in rows:
        sums[left, word] += n
    frequent = {group: n for group, n in sums.items() if n >= 9}
    assert 0 < len(frequent) < len(sums)
    found = phrases.counted(groups, 9, "left", "word")
    got = found.collect()
    assert Counter((r.block, r.left, r.word) for r in got) == Counter((b, left, word) for b, left, word, _ in rows if (left, word) in frequent)
    assert {(r.left, r.word): r.a for r in got if r.first} == frequent and sum(r.first for r in got) == len(frequent)
    numbers = {(r.left, r.word, r.id) for r in got}
    assert len(numbers) == len({n for _, _, n in numbers}) == len(frequent) and min(n for _, _, n in numbers) > 0
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    summed = phrases.totalled(groups, 9, "left", "word")
    assert {(r.left, r.word): r.a for r in summed.collect()} == frequent
    assert "partial_sum(n" in summed._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates(spark, nothing):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    base = [word() for _ in range(150)]
    def edited(text, n):
        out = list(text)
        for at in rng.sample(range(len(out)), n):
            out[at] = word() + "z"
        return out

    texts = [" ".join(edited(base, rng.choice([0, 1, 2, 3, 4, 5, 8]))) for _ in range(1200)]  # a group in which many are too far from one another
    chain = [word() for _ in range(120)]
    for _ in range(12):  # each near the one before only
        texts.append(" ".join(chain))
        chain = edited(chain, 2)
    texts += [" ".join(word() for _ in range(80)) for _ in range(60)] + ["", None, "one", "ONE", "one two", texts[3].upper()]
    sets = [np.unique(near.shingles(t or "")) for t in texts]
    names: dict[int, int] = {}
    flat = np.concatenate([[names.setdefault(int(v), len(names)) for v in s] for s in sets])
    table = np.zeros((len(sets), len(names)), np.float32)
    table[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), flat] = 1
    shared, sizes = table @ table.T, table.sum(1)
    linked = shared / (sizes[:, None] + sizes[None] - shared) >= near.SIMILARITY
    root = np.arange(len(sets))
    while True:
        lower = np.array([root[linked[i]].min() for i in range(len(root))])
        if (lower[lower] == root).all():
            break
        root = lower[lower]
    frame = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string").repartition(4)
    found = {r["node"]: r["root"] for r in near.components(near.near_links(frame)).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == root.tolist()
    assert len(set(root.tolist())) > 300 and np.bincount(root).max() > 100
    rows = [(i, t, "en", "s", None, "f", 1, "b") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", None, "f", 2, "b"), (None, texts[0], None, None, None, None, 3, None)]
    kept = near.drop_similar(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root.tolist())) and near.drop_similar(nothing).count() == 0


NAMES = ["row", "__row", "__row_of", "__copy", "copy", "__file", "__line", "file", "line", "document", "key", "bits", "size", "copies", "component_id", "root"]


def test_near_duplicates_by_fingerprint(spark, monkeypatch):
    """Without any shared key the trie walk still finds what lies within its bits."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        words = [f"t{w}" for w in rng.integers(0, 5000, 1500)]
        texts.append(" ".join(words))
        texts.append(" ".join(["edited", *words[1:]]))
    prints = [simhash.text_fingerprint(t, near.WORDS) for t in texts]
    close = {2 * k + 1 for k in range(12) if (prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= near.BUDGET}
    keyed = near.keyed
    monkeypatch.setattr(near, "keyed", lambda rows: keyed(rows).withColumn("keys", F.array("row")))
    kept = {r["doc_id"] for r in near.drop_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert len(close) >= 10 and kept == set(range(24)) - close


@pytest.mark.parametrize("drop", [exact.drop_exact, near.drop_similar, simhash.drop_near, mixing.mixed])
def test_names_of_helpers_as_extra_columns(spark, drop):
    rows = [(i, f"text number {i // 2}", "s", *[f"{n}{i}" for n in NAMES]) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in NAMES))
    got = drop(frame)
    assert got.columns == frame.columns
    kept = got.collect()
    assert kept and all(tuple(r) in rows for r in kept)
