"""The operators against plain versions, on rows with every edge case."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from wayside.llm import bpe, exact, fingerprint, mixing, quality, simhash, suffix_lm, token_files, toxicity, urls

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BLANK = "[\x20\x09-\x0d]+"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, file string, row bigint, body string"
LONG = " ".join(f"w{i * i % 977}x" for i in range(30000))
PROSE = "The quick brown fox jumps over the lazy dog while seven wizards brew a strange green potion in the cellar"
TEXTS = [
    None, "", " \t ", "one", "one", "Two words", "two words", "two\x0bwords", "É ü ß naïve İstanbul ΑΣ", "x\u00a0y \u00a0",
    "<|endoftext|> <|ENDOFTEXT|>.", "a" * 400, PROSE, PROSE, PROSE.replace("seven", "eight"), PROSE.upper(), "don't stop--now!! 42",
    LONG, LONG + " tail", "word " * 300, "日本語 テキスト", "e\u0301te\u0301 e\u0301",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", None, "f", i, "b") for i, t in enumerate(TEXTS)]
    rows += [(12, PROSE, "en", "s0", 1, None, None, None), (None, PROSE, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    frames = [
        fingerprint.compared_with_edits(nothing), fingerprint.fingerprints(nothing), simhash.near_groups(nothing), exact.exact_groups(nothing),
        urls.judge_urls(spark.createDataFrame([], "url string, host int"), [("net", "/", "block")]), bpe.digests(nothing, VOCABULARY),
        toxicity.toxicity_scores(nothing, toxicity.train(nothing, labels)), quality.quality_scores(nothing, quality.train(nothing, labels)),
        suffix_lm.score_texts(nothing), mixing.mix(nothing), token_files.read_tokens(token_files.write_tokens(nothing, VOCABULARY)),
        exact.drop_exact(nothing), simhash.drop_near(nothing), mixing.mixed(nothing),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_fingerprints(docs):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = dict(sorted((i, t) for i, t, _ in rows_of(unique)))
    ids = list(texts)
    got = {r["doc_id"]: r for r in fingerprint.compared_with_edits(unique).collect()}
    prints = {}
    for i, following in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[i], texts[following]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert prints.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert 0 <= got[i]["near_edited"] <= 1 and (got[i]["near_next"] == 1 or t != n)
    assert got[17]["near_next"] > 0.9 and got[12]["near_next"] == 1 and got[16]["near_next"] < 0.2
    assert fingerprint.compared_with_edits(docs).count() == docs.count()


def test_equal_passages_share_phrases():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 123, 4000).astype(np.uint32)
    offset = np.concatenate((rng.integers(97, 123, 37).astype(np.uint32), passage))
    a, b = fingerprint.prints([passage, offset], 1 << 20)
    shared = len(np.intersect1d(a[1], b[1]))
    assert shared > 0.9 * len(a[1])


def plain_simhash(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(pairs, members):
    root = {m: m for m in members}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {m: find(m) for m in members}


def test_simhash_groups(docs):
    prints = [(i, plain_simhash(t)) for i, t, _ in rows_of(docs)]
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a][1] ^ prints[b][1]).bit_count() <= 2]
    place = components_of(near, range(len(prints)))
    least = defaultdict(list)
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[place[k]].append(i)
    want = Counter((i, p, min(least[place[k]])) for k, (i, p) in enumerate(prints))
    got = Counter((r["doc_id"], r["bits"] % (1 << 64), r["component_id"]) for r in simhash.near_groups(docs).collect())
    assert got == want
    kept = [r["doc_id"] for r in simhash.drop_near(docs).collect()]
    assert sorted(kept) == sorted(min(v) for v in least.values())


def test_trie_goes_deeper_where_many_are_alike(spark):
    rng = np.random.default_rng(5)
    bits = np.repeat(rng.integers(0, 1 << 63, 3, dtype=np.uint64), 150)
    for _ in range(4):
        bits ^= np.uint64(1) << rng.integers(0, 64, len(bits), dtype=np.uint64)
    bits = np.unique(bits)
    df = spark.createDataFrame([(int(b),) for b in bits.view(np.int64)], "bits bigint")
    found = simhash.links(df, 2, pair_rows=40).collect()
    near = [(a, b) for a in range(len(bits)) for b in range(a) if int(bits[a] ^ bits[b]).bit_count() <= 2]
    number = {int(b): k for k, b in enumerate(bits.view(np.int64))}
    assert components_of([(number[r["a"]], number[r["b"]]) for r in found], range(len(bits))) == components_of(near, range(len(bits)))
    member = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 2, pair_rows=40)).collect()}
    want = components_of(near, range(len(bits)))
    same = lambda f: {frozenset(k for k in number if f(k) == v) for v in map(f, number)}
    assert same(lambda k: member.get(k, k)) == same(lambda k: want[number[k]])


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(docs, weak):
    from pyspark.sql import functions as F

    digest = (lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1).cast("binary")) if weak else exact.sha256
    groups = defaultdict(list)
    for i, t, _ in rows_of(docs):
        groups[re.sub(BLANK, " ", t)].append(i)
    want = Counter((i, min(x for x in g if x is not None), len(g)) for g in groups.values() for i in g)
    got = exact.exact_groups(docs, digest).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    if not weak:
        kept = exact.drop_exact(docs)
        assert kept.columns == docs.columns and kept.count() == len(groups)


def test_state_remembers_files(spark, docs):
    from wayside.session import scratch_path

    state, digests = scratch_path(spark, "state"), scratch_path(spark, "digests")
    rows = exact.located(docs).select(exact.sha256(exact.normalised()).alias("digest"), "doc_id", "file", "line")
    for _ in range(2):
        rows.write.mode("append").parquet(digests)
        exact.observe(spark, digests, state)
    assert exact.remembered(spark, state).agg({"n": "sum"}).head()[0] == 2 * docs.count()


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("EXAMPLE.net", "/en/x", "block"), ("org", "/fr/", "allow")]
    given = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?q=://b", "x://example.net", "x://example.net/en/xy#f", "x://netx/",
             "x://anet/", "x://a.b.org/fr/", "x://org/fr/?", "x://.net/", "x://exämple.net/", "x://net:80/", "x://example.net/en/1"] * 2
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(given)], "page_id int, url string, host string, top int")
    got = {r["page_id"]: r for r in urls.judge_urls(pages, rules).collect()}
    for i, u in enumerate(given):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h) + len(p), v == "block", h.lower() + p, v) for h, p, v in rules if f".{host}".endswith(f".{h.lower()}") and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"], got[i]["top"]) == (host, path, *best[2:], 1)


def test_tokens_round_trip(docs):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    want = Counter((i, " ".join(map(str, ids(t))), tokenizer.decode(ids(t), skip_special_tokens=False)) for i, t, _ in rows_of(docs))
    assert Counter((r["doc_id"], r["ids"], r["decoded"]) for r in bpe.encode_decode(docs, VOCABULARY).collect()) == want
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in bpe.encode(docs, VOCABULARY).collect()) == Counter((i, tuple(ids(t))) for i, t, _ in rows_of(docs))
    unique = docs.dropDuplicates(["doc_id"])
    start, files = 0, {r["doc_id"]: r for r in token_files.read_tokens(token_files.write_tokens(unique, VOCABULARY, length=64)).collect()}
    for i, t, _ in sorted(rows_of(unique), key=lambda r: (r[0] is not None, r[0])):
        seq = np.array([*ids(t), 1], "<u4")
        assert (files[i]["start"], files[i]["n_tokens"], files[i]["ids_crc32"]) == (start, len(seq), zlib.crc32(seq.tobytes()))
        start += len(seq)


def test_mix(docs):
    sizes = [(i, s, len(re.findall("[^\x20\x09-\x0d]+", t))) for i, t, s in rows_of(docs)]
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(sizes)
    totals = Counter()
    for _, s, n in sizes:
        totals[s] += n
    names = sorted(totals, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, rest, free = {}, 1.5 * sum(totals.values()), set(names)
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if 2 * totals[s] <= level * weight[s]} or free
        for s in full:
            target[s] = min(2 * totals[s], level * weight[s])
        rest, free = rest - sum(target[s] for s in full), free - full
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) <= 1.5 * sum(totals.values()) + 1e-6
    again = mixing.mixed(docs)
    assert again.columns == docs.columns
    assert Counter(r["doc_id"] for r in again.collect()) == Counter({k: v for k, v in _copies(got).items() if v})


def _copies(rows):
    out = Counter()
    for r in rows:
        out[r["doc_id"]] += r["copies"]
    return out


def test_language_model(docs):
    texts = [(i, [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))]) for i, t, _ in rows_of(docs)]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter(w for i, ws in texts if not held(i) for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), n, round(sum(log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, None]), 5)) for i, ws in texts)
    got = suffix_lm.score_texts(docs, frequent=1e-3).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got) and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_state_distributions_sum_to_one():
    tree = suffix_lm.SuffixTree(np.array([0.2, 0.0, 0.1, 0.4, 0.3]), 100, 0.5, 0.01)
    tree.levels.append(suffix_lm.Level(np.array([4]), np.array([6.0]), np.array([16.0]), np.array([(0 << suffix_lm.BITS) + 3]), np.array([10.0])))
    level = tree.levels[0]
    p = (np.array([0, 0, 0, 10, 0]) + level.rest[0] * tree.root) / level.total[0]
    assert p.sum() == pytest.approx(1)


def test_classifiers(spark):
    rng = np.random.default_rng(2)
    syllables = ["ka", "lo", "mi", "tun", "es", "ra", "vo", "be"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.integers(5, 120))]
        bad, toxic = i % 4 == 0, i % 3 == 0
        if toxic:
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(["zzgrub", "zzgrok"])) + word())
        rows.append((i, " ".join(w + "$$%" if bad else w for w in words), "x"))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None, "x"), (1001, "", "x")], "doc_id bigint, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 0)], "doc_id bigint, quality int, toxic int")
    for got, column, least in (
        (quality.quality_scores(docs, quality.train(docs, marks)), 1, 0.95),
        (toxicity.toxicity_scores(docs, toxicity.train(docs, marks)), 2, 0.85),
    ):
        found = {r["doc_id"]: r for r in got.collect()}
        held = [x for x in labels if found[x[0]]["held_out"]]
        assert held and np.mean([found[x[0]]["predicted"] == x[column] for x in held]) >= least
        assert all(0 <= r["score"] <= 1 for r in found.values()) and len(found) == 402
    kept = quality.keep_good(docs, quality.train(docs, marks))
    assert kept.columns == docs.columns
