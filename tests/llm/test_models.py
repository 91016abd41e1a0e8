"""The two classifiers and the parser of fingerprints against plain arithmetic, one number at a time."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from llm.test_operators import PROSE, TEXTS
from wayside.llm import fingerprint, quality, toxicity

SAMPLE = [(t or "")[:3000] for t in TEXTS] + ["A|B | c\nA|B | c\n\nthe end!! ..", "word", "1 2 3 $$ %% ## x"]


def plain_features(text: str) -> list[float]:
    raw = text.encode()
    words, lines = raw.split(), raw.split(b"\n")
    if not words:
        return [0.0] * len(quality.FEATURES)
    blank = b" \t\n\r\x0b\x0c"
    def kind(b: int) -> str:
        c = chr(b)
        if b >= 128:
            return "other"
        if "A" <= c <= "Z":
            return "upper"
        if c.isdigit():
            return "digit"
        if c in ".,;:'\"()-?!":
            return "mark"
        if c in "#$%&*+/<=>@[\\]^_`{}~":
            return "symbol"
        return "pipe" if c == "|" else ""

    kinds = [kind(b) for b in raw]
    part = lambda k: kinds.count(k) / len(raw)
    signs = ("mark", "symbol", "pipe")
    return [
        math.log1p(len(words)), len(raw) / len(words), len(set(words)) / len(words),
        sum(a == b for a, b in zip(words, words[1:])) / len(words), max(map(words.count, set(words))) / len(words),
        part("upper"), part("digit"), part("mark"), part("symbol"), part("pipe"), part("other"),
        math.log1p(len(words) / len(lines)), len(set(lines)) / len(lines),
        sum(k == "upper" and (i == 0 or raw[i - 1] in blank) for i, k in enumerate(kinds)) / len(words),
        sum(a in signs and b in signs for a, b in zip(kinds, kinds[1:])) / len(raw),
    ]


def test_features_one_by_one():
    got = quality.features(SAMPLE)
    for text, row in zip(SAMPLE, got):
        assert row.tolist() == pytest.approx(plain_features(text)), text[:40]
    assert np.array_equal(got, np.concatenate([quality.features([t]) for t in SAMPLE]))


def test_additive_scores_are_sums_of_table_entries():
    draw = np.random.default_rng(2)
    x = draw.standard_normal((400, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(float)
    model = quality.fit(x, y)
    assert model.pairs and np.mean((model.logits(x) > 0) == y) > 0.85  # an exclusive or needs the pair
    bin_of = lambda cuts, v: sum(v >= c for c in cuts)
    for row, logit in zip(x[:50], model.logits(x[:50])):
        total = model.intercept + sum(t[bin_of(c, v)] for t, c, v in zip(model.tables, model.cuts, row))
        total += sum(t[bin_of(model.pair_cuts[i], row[i]), bin_of(model.pair_cuts[j], row[j])] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert logit == pytest.approx(total)


def plain_logit(w: dict, words: list[bytes]) -> float:
    """A window's logit by the textbook equations; a short window is filled up with empty steps that attention does not see."""
    squash = lambda v: 1 / (1 + np.exp(-v))
    steps = []
    for word in words:
        word = toxicity.bare(word)
        shape = b"\x01" + word + b"\x01\x01\x01"
        grams = []
        for i in range(len(word) + 2):
            a, b, c = shape[i : i + 3]
            grams.append((((a << 16 | b << 8 | c) * 2654435761) % 2**32) >> 18)
        steps.append(w["word"][zlib.crc32(word) % toxicity.WORDS] + np.mean([w["gram"][g] for g in grams], axis=0))
    steps += [np.zeros(toxicity.SIZE)] * (toxicity.WINDOW - len(steps))
    n, both = toxicity.HIDDEN, [[None] * len(steps), [None] * len(steps)]
    for d, side in enumerate("fb"):
        h = np.zeros(n)
        for t in range(len(steps)) if d == 0 else reversed(range(len(steps))):
            a, r = steps[t] @ w[f"w{side}"] + w[f"b{side}"], h @ w[f"u{side}"]
            reset, update = squash(a[:n] + r[:n]), squash(a[n : 2 * n] + r[n : 2 * n])
            h = (1 - update) * np.tanh(a[2 * n :] + reset * r[2 * n :]) + update * h
            both[d][t] = h
    states = [np.concatenate(s) for s in zip(*both)]
    seen = states[: len(words)] if words else states
    scores = np.array([np.tanh(s @ w["aw"] + w["ab"]) @ w["av"] for s in seen])
    weight = np.exp(scores - scores.max())
    pooled = sum(p * s for p, s in zip(weight / weight.sum(), seen))
    return float(pooled @ w["ow"] + w["ob"][0])


def test_network_forward():
    network = toxicity.Network.start(3)
    w = {k: v.astype(float) for k, v in network.weights.items()}
    texts = ["", "one", PROSE, "a bb ccc " * 90, "É ü, «ß» (x)!"]
    got = toxicity.Scorer(network)(texts)
    for text, score in zip(texts, got):
        words = text.encode().split()
        size, step = toxicity.WINDOW, toxicity.STRIDE
        starts = [0] if len(words) <= size else sorted({min(s, len(words) - size) for s in range(0, len(words) - size + step, step)})
        worst = max(plain_logit(w, words[s : s + size]) for s in starts)
        assert score == pytest.approx(1 / (1 + math.exp(-worst)), abs=2e-5), text[:20]


def test_network_gradients():
    network = toxicity.Network.start(5)
    draw = np.random.default_rng(4)
    gates = (draw.standard_normal((6, 3, 6 * toxicity.HIDDEN)) * 0.5).astype(np.float32)
    mask = np.arange(6)[:, None] < np.array([6, 4, 1])
    error = np.array([0.7, -1.1, 0.4], np.float32)
    _, kept = network.run(gates, mask, keep=True)
    slopes, of_gates = network.slopes(kept, error)
    loss = lambda: float((network.run(gates, mask).astype(float) * error).sum())
    def rising(array: np.ndarray, place: tuple) -> float:
        before, change = array[place], 1e-2
        array[place] = before + change
        high = loss()
        array[place] = before - change
        low = loss()
        array[place] = before
        return (high - low) / (2 * change)

    for name in ("uf", "ub", "aw", "ab", "av", "ow", "ob"):
        for flat in np.argsort(-np.abs(slopes[name]).ravel())[:4]:
            place = np.unravel_index(flat, slopes[name].shape)
            assert slopes[name][place] == pytest.approx(rising(network.weights[name], place), rel=0.05, abs=2e-3), name
    for flat in np.argsort(-np.abs(of_gates).ravel())[:8]:
        place = np.unravel_index(flat, of_gates.shape)
        assert of_gates[place] == pytest.approx(rising(gates, place), rel=0.05, abs=2e-3)


MASK = 2**64 - 1


def mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def toss(left: int, own: int) -> int:
    """Position and value of the lowest bit in which a symbol differs from its left neighbour."""
    place = ((left ^ own) & -(left ^ own)).bit_length() - 1 if left != own else 0
    return 2 * place + ((own >> place) & 1)


def plain_parse(symbols: list[int]) -> tuple[int, list[int]]:
    """The name of a whole text and the names of its phrases of all levels."""
    phrases, level = [], 0
    while symbols:
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        named = [mixed(s) if n == 1 else mixed(mixed(s) ^ (n * 0x94D049BB133111EB & MASK)) for s, n in runs]
        labels = [s for s, _ in runs]
        for _ in range(4):
            labels = [labels[0] & 1] + [toss(a, b) for a, b in zip(labels, labels[1:])]
        cuts = [0] + [i for i in range(1, len(labels) - 1) if labels[i - 1] < labels[i] > labels[i + 1]] + [len(labels)]
        level += 1
        symbols = [
            mixed((sum(mixed(named[i] ^ ((i - a + 1) * 0xBF58476D1CE4E5B9 & MASK)) for i in range(a, b)) & MASK) ^ level)
            for a, b in zip(cuts, cuts[1:])
        ]
        phrases += symbols
        if len(symbols) == 1:
            return symbols[0], phrases
    return 0, []


def test_fingerprints_are_those_of_a_plain_parser():
    texts = SAMPLE + ["aaaa", "ab" * 200, "word " * 120, PROSE * 3, PROSE + PROSE[:40]]
    points = [fingerprint.code_points(t) for t in texts]
    whole = fingerprint.prints(points)
    for text, alone, (name, sketch) in zip(texts, points, whole):
        plain_name, phrases = plain_parse(alone.tolist())
        assert name == plain_name, text[:30]
        assert sketch.tolist() == sorted({p >> 32 for p in phrases})[: fingerprint.SKETCH]
        again = fingerprint.prints([alone])[0]  # whatever else is parsed with it
        assert again[0] == name and np.array_equal(again[1], sketch)
    for a in range(0, len(texts), 3):
        for b in range(len(texts)):
            (n, x), (m, y) = whole[a], whole[b]
            union = sorted({*x.tolist(), *y.tolist()})[: fingerprint.SKETCH]
            shared = len(set(union) & set(x.tolist()) & set(y.tolist()))
            want = 1.0 if n == m else 2 * shared / (len(union) + shared) if union else 0.0
            assert fingerprint.likeness(whole[a], whole[b]) == pytest.approx(want)
