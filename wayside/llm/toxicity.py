"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of what two tables say: an embedding of the word (hashed) and the mean embedding of its character
trigrams. Two recurrent networks read a window of words forwards and backwards, attention weighs their states, and a
logistic unit scores the window. Windows overlap by half and cover the whole text; a document has the score of its
worst window.

Training takes at most ``PER_CLASS`` labelled rows of either class outside the held-out fold. Labels are known for
documents only, so each round trains on the window of each document that the model of the last round thinks worst (at
first that with the words most typical of toxic documents) and, for clean documents, on a second window at random.

Edge cases: a null text counts as empty; a text without words has the score of an empty window; a sample without rows or
with one class gives a constant score, the rate of label 1 (0 without rows); extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from wayside.llm.labelled import scored, scorer, training_sample

PER_CLASS, THRESHOLD = 3_000, 0.5
WINDOW, STRIDE = 32, 16
WORDS, GRAMS, SIZE, HIDDEN = 1 << 17, 1 << 14, 12, 8
#: Passes over the windows in a round, more where that makes fewer than ``STEPS`` steps.
ROUNDS, PASSES, STEPS, BATCH, RATE = 3, 3, 90, 256, 0.01
#: Words whose projections a task remembers, and characters scored together.
MEMORY, BLOCK = 200_000, 1 << 20
#: Marks cut off both ends of a word.
MARKS = b".,;:!?\"'()[]#$%&*|-"


def bare(word: bytes) -> bytes:
    return word.strip(MARKS).lower()


def keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the word table; rows of the trigram table of all words one after the other, and where each word's begin."""
    slot = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORDS
    data = np.frombuffer(b"".join([b"\x01" + w + b"\x01" for w in words]) + b"\x01", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    code = (data[:-1] << 16) | (data[1:] << 8)
    code[:-1] |= data[2:]
    code[starts + sizes - 1] = 0x010101  # a word's last trigram does not reach into the next word
    code *= np.uint32(2654435761)
    return slot, (code >> np.uint32(18)).astype(np.int64), starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Weights: ``word``, ``gram``; per direction ``w`` (input), ``b``, ``u`` (recurrent); attention ``aw, ab, av``; output ``ow, ob``."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def start(seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        normal = lambda *shape: (draw.standard_normal(shape) * 0.3).astype(np.float32)
        w = {"word": normal(WORDS, SIZE) * 0.1, "gram": normal(GRAMS, SIZE) * 0.1}
        for side in "fb":
            w |= {f"w{side}": normal(SIZE, 3 * HIDDEN), f"b{side}": np.zeros(3 * HIDDEN, np.float32), f"u{side}": normal(HIDDEN, 3 * HIDDEN)}
        w |= {"aw": normal(2 * HIDDEN, HIDDEN), "ab": np.zeros(HIDDEN, np.float32), "av": normal(HIDDEN), "ow": normal(2 * HIDDEN), "ob": np.zeros(1, np.float32)}
        return Network(w)

    def inputs(self, words: list[bytes], keep: np.ndarray | None = None) -> np.ndarray:
        """One row per word; ``keep`` scales what the word table says."""
        slot, gram, starts = keys(words)
        sizes = np.diff(np.append(starts, len(gram)))
        means = np.add.reduceat(self.weights["gram"][gram], starts, axis=0) / sizes[:, None].astype(np.float32)
        whole = self.weights["word"][slot]
        return (whole if keep is None else whole * keep) + means

    def project(self, x: np.ndarray) -> np.ndarray:
        """What the gates of both directions get from inputs."""
        w = self.weights
        return np.concatenate((x @ w["wf"] + w["bf"], x @ w["wb"] + w["bb"]), axis=1)

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; ``gates`` (steps, windows, 6 HIDDEN), ``mask`` (steps, windows) true where there is a word."""
        steps, n, _ = gates.shape
        w, h3 = self.weights, 3 * HIDDEN
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        saved = []
        for d, side in enumerate("fb"):
            h, u = np.zeros((n, HIDDEN), np.float32), w[f"u{side}"]
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                a, r = gates[t, :, d * h3 : (d + 1) * h3], h @ u
                rz = _sigmoid(a[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
                new = np.tanh(a[:, 2 * HIDDEN :] + rz[:, :HIDDEN] * r[:, 2 * HIDDEN :])
                nxt = new + rz[:, HIDDEN:] * (h - new)
                if keep:
                    saved.append((d, t, h, rz, new, r[:, 2 * HIDDEN :].copy()))
                h = nxt
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        seen = np.tanh(states @ w["aw"] + w["ab"])
        weight = np.where(mask, seen @ w["av"], np.float32(-1e9))
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logits = pooled @ w["ow"] + w["ob"]
        return (logits, (gates, states, seen, weight, pooled, saved)) if keep else logits

    def slopes(self, kept, error: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights behind the gates, and of the gates; ``error`` is the gradient of the logits."""
        gates, states, seen, weight, pooled, saved = kept
        w, h3 = self.weights, 3 * HIDDEN
        g = {"ow": pooled.T @ error, "ob": error.sum(keepdims=True)}
        d_pool = error[:, None] * w["ow"]
        d_states = weight[:, :, None] * d_pool
        d_weight = np.einsum("tnh,nh->tn", states, d_pool)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["av"] = np.einsum("tnh,tn->h", seen, d_score)
        d_seen = d_score[:, :, None] * w["av"] * (1 - seen**2)
        g["aw"], g["ab"] = np.einsum("tnh,tnk->hk", states, d_seen), d_seen.sum((0, 1))
        d_states = d_states + d_seen @ w["aw"].T
        d_gates = np.empty_like(gates)
        back, before = None, None
        for d, t, h, rz, new, r_new in reversed(saved):
            side = "fb"[d]
            u = w[f"u{side}"]
            if before != d:
                back, before = np.zeros_like(h), d
                g[f"u{side}"] = np.zeros_like(u)
            dh = d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN] + back
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            d_new = dh * (1 - z) * (1 - new**2)
            d_z = dh * (h - new) * z * (1 - z)
            d_r = d_new * r_new * r * (1 - r)
            d_a = np.concatenate((d_r, d_z, d_new), 1)
            d_u = np.concatenate((d_r, d_z, d_new * r), 1)
            d_gates[t, :, d * h3 : (d + 1) * h3] = d_a
            g[f"u{side}"] += h.T @ d_u
            back = dh * z + d_u @ u.T
        return g, d_gates


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and document of every window over documents that follow each other."""
    count = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(lengths)), count)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    n = lengths[owner]
    begin = np.minimum(turn * STRIDE, np.maximum(n - WINDOW, 0))
    return (np.cumsum(lengths) - lengths)[owner] + begin, np.minimum(n, WINDOW), owner


def grid(first: np.ndarray, size: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (steps, windows) and which of them are in the window; those outside point at position ``total``."""
    step = np.arange(WINDOW)[:, None]
    mask = step < size
    return np.where(mask, first + step, total), mask


class _Known(dict):
    """Numbers words in the order of their first appearance and lists those that are new."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        self.fresh.append(word)
        return n


class Scorer:
    """Scores texts; remembers the projections of words, row 0 being that of no word."""

    def __init__(self, network: Network):
        self.network = network
        self.known = _Known()
        self.rows = network.project(np.zeros((1, SIZE), np.float32))

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > MEMORY:
            self.known, self.rows = _Known(), self.rows[:1]
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if fresh := self.known.fresh:
            total = len(self.known) + 1
            if total > len(self.rows):
                room = np.empty((max(total, 2 * len(self.rows)), self.rows.shape[1]), np.float32)
                room[: len(self.rows)] = self.rows
                self.rows = room
            self.rows[total - len(fresh) : total] = self.network.project(self.network.inputs([bare(x) for x in fresh]))
            self.known.fresh = []
        return numbers

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit and document of every window, and where its first word is in the document."""
        words = [t.encode("utf-8", "replace").split() for t in texts]
        lengths = np.array([len(x) for x in words], np.int64)
        numbers = np.append(self._numbers([x for doc in words for x in doc]), 0)
        first, size, owner = windows(lengths)
        out = np.empty(len(first), np.float32)
        for at in range(0, len(first), 4096):
            part = slice(at, at + 4096)
            places, mask = grid(first[part], size[part], len(numbers) - 1)
            mask = mask | (size[part] == 0)
            out[part] = self.network.run(self.rows[numbers[places]], mask)
        return out, owner, first - (np.cumsum(lengths) - lengths)[owner]

    def __call__(self, texts: list[str]) -> np.ndarray:
        """The score of the worst window of every text."""
        worst = np.full(len(texts), -np.inf)
        at = 0
        while at < len(texts):
            end, n = at, 0
            while end < len(texts) and (end == at or n + len(texts[end]) <= BLOCK):
                n, end = n + len(texts[end]), end + 1
            logit, owner, _ = self.logits(texts[at:end])
            np.maximum.at(worst, owner + at, logit.astype(float))
            at = end
        return _sigmoid(worst)


def _typical(docs: list[list[bytes]], y: np.ndarray) -> dict[bytes, float]:
    """How much more often a word is in documents of label 1, as a smoothed log ratio."""
    counts: dict[bytes, list[int]] = {}
    for words, label in zip(docs, y.astype(int).tolist()):
        for word in set(words):
            counts.setdefault(word, [0, 0])[label] += 1
    one = max(1.0, y.sum())
    zero = max(1.0, len(y) - y.sum())
    return {w: float(np.log((b + 0.1) / one) - np.log((a + 0.1) / zero)) for w, (a, b) in counts.items() if a + b > 1}


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Network:
    """Train on texts and 0/1 labels."""
    net = Network.start(seed)
    y = np.asarray(labels, dtype=np.float32)
    w = net.weights
    if not len(y) or y.min() == y.max():
        w["ow"][:] = 0
        w["ob"][:] = 20 * (2 * y.mean() - 1) if len(y) else -20
        return net
    docs = [[bare(x) for x in t.encode("utf-8", "replace").split()] for t in texts]
    typical = _typical(docs, y)
    draw = np.random.default_rng(seed)
    memory = {k: np.zeros_like(v) for k, v in w.items()}
    chosen = np.zeros(len(docs), np.int64)
    for k, words in enumerate(docs):
        worth = np.array([max(0.0, typical.get(x, 0.0)) ** 2 for x in words] or [0.0])
        total = np.concatenate(([0.0], np.cumsum(worth)))
        begins = np.minimum(np.arange(0, max(1, len(words)), STRIDE), max(0, len(words) - WINDOW))
        chosen[k] = begins[np.argmax(total[np.minimum(begins + WINDOW, len(words))] - total[begins])]
    for round_ in range(ROUNDS):
        if round_:
            scorer_ = Scorer(net)
            for at in range(0, len(texts), 64):
                logit, owner, first = scorer_.logits(texts[at : at + 64])
                order = np.lexsort((-logit, owner))
                top = order[np.unique(owner[order], return_index=True)[1]]
                chosen[at : at + 64] = first[top]
        steps = -(-(len(y) + int((y == 0).sum())) // BATCH)
        for _ in range(max(PASSES, -(-STEPS // steps))):
            _pass(net, memory, docs, y, chosen, draw)
    return net


def _pass(net: Network, memory: dict, docs: list, y: np.ndarray, chosen: np.ndarray, draw: np.random.Generator) -> None:
    cases = [(k, int(chosen[k])) for k in range(len(docs))]
    cases += [(k, int(draw.integers(0, max(1, len(docs[k]) - WINDOW + 1)))) for k in np.flatnonzero(y == 0)]
    order = draw.permutation(len(cases))
    # Each label has half of the weight.
    wanted = np.array([y[k] for k, _ in cases])
    weigh = np.where(wanted > 0, 0.5 / wanted.sum(), 0.5 / (len(cases) - wanted.sum())) * len(cases)
    for at in range(0, len(order), BATCH):
        part = order[at : at + BATCH]
        found = [docs[k][s : s + WINDOW] for k, s in (cases[i] for i in part)]
        listed = list(dict.fromkeys(x for words in found for x in words)) or [b""]
        number = {x: i for i, x in enumerate(listed)}
        places = np.full((WINDOW, len(part)), len(listed), np.int64)
        for n, words in enumerate(found):
            places[: len(words), n] = [number[x] for x in words]
        mask = places < len(listed)
        mask |= ~mask.any(0)
        # Half of the words are known by their trigrams only, so that unseen words are read, too.
        keep = (draw.random((len(listed), 1)) < 0.5).astype(np.float32)
        x = np.concatenate((net.inputs(listed, keep), np.zeros((1, SIZE), np.float32)))
        gates = net.project(x)[places]
        logits, kept = net.run(gates, mask, keep=True)
        error = ((_sigmoid(logits) - wanted[part]) * weigh[part] / len(part)).astype(np.float32)
        g, d_gates = net.slopes(kept, error)
        h3 = 3 * HIDDEN
        flat = np.zeros((len(x), 2 * h3), np.float32)
        np.add.at(flat, places.ravel(), d_gates.reshape(-1, 2 * h3))
        d_x = np.zeros_like(x)
        for d, side in enumerate("fb"):
            own = flat[:, d * h3 : (d + 1) * h3]
            g[f"w{side}"], g[f"b{side}"] = x.T @ own, own.sum(0)
            d_x += own @ net.weights[f"w{side}"].T
        slot, gram, starts = keys(listed)
        sizes = np.diff(np.append(starts, len(gram)))
        _step(net.weights, memory, g)
        for name, rows, values in (
            ("word", slot, d_x[:-1] * keep), ("gram", gram, np.repeat(d_x[:-1] / sizes[:, None].astype(np.float32), sizes, axis=0)),
        ):
            own, where = np.unique(rows, return_inverse=True)
            total = np.zeros((len(own), SIZE), np.float32)
            np.add.at(total, where, values)
            memory[name][own] += total**2
            net.weights[name][own] -= 0.1 * total / (np.sqrt(memory[name][own]) + 1e-6)


def _step(weights: dict, memory: dict, g: dict) -> None:
    """Root-mean-square scaled descent."""
    for name, value in g.items():
        m = memory[name]
        m *= 0.95
        m += 0.05 * value**2
        weights[name] -= RATE * value / (np.sqrt(m) + 1e-6)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Network:
    """The network from labelled rows outside the held-out fold."""
    rows = training_sample(docs, labels, label, per_class)
    return fit(rows["text"].tolist(), rows["label"].to_numpy(dtype=np.float32))


def toxicity_scores(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(network.weights)
    return scored(docs, scorer(lambda: Scorer(Network(sent.value))), threshold)
