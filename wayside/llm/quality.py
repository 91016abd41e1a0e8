"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins at quantiles of the training sample. Boosting goes round the features in turn and
adds to each a shallow tree over its bins, fitted to the gradient of the log loss and scaled down; then it goes round the
pairs of features whose best four-field cut explains most of what is left. What remains is one lookup table per feature
and pair: a score is the sigmoid of the sum of the entries of a text's bins.

Training: at most ``PER_CLASS`` labelled rows of either class, none of the held-out fold. Features come from the text only.

Edge cases: a null text counts as empty and is scored from features that are all zero; a sample without rows or with one
class gives a constant score, the rate of label 1 (0.5 without rows); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from wayside.llm.common import text_of
from wayside.llm.labelled import blocks, scored, scorer, training_sample

PER_CLASS, BINS, PAIR_BINS, PAIRS = 10_000, 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, SHRINK = 150, 60, 0.1, 5.0
#: Documents scoring below go.
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_next", "top_word", "upper", "digits", "marks", "symbols",
    "pipes", "non_ascii", "log_line", "distinct_lines", "capitals", "doubled_marks",
)

_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in " \t\n\r\x0b\x0c"]] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[ord(c) for c in ".,;:'\"()-?!"]] = 4
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 5
_KIND[ord("|")] = 6
_KIND[128:] = 7


def features(texts: list[str]) -> np.ndarray:
    """One row per text."""
    out = np.zeros((len(texts), len(FEATURES)))
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    kinds = _KIND[np.frombuffer(b"".join(raw), np.uint8)]
    starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
    count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    share = {k: count(kinds == k) / sizes[some] for k in (2, 3, 4, 5, 6, 7)}
    marks = kinds >= 4
    marks &= kinds < 7
    doubled = np.zeros(len(kinds), bool)
    doubled[1:] = marks[1:] & marks[:-1]
    share["doubled"] = count(doubled) / sizes[some]
    after_blank = np.ones(len(kinds), bool)
    after_blank[1:] = kinds[:-1] == 1
    after_blank[starts] = True
    after_blank &= kinds == 2
    capitals = count(after_blank)
    for row, i in enumerate(some.tolist()):
        words = raw[i].split()
        n = len(words)
        if not n:
            continue
        distinct = Counter(words)
        lines = raw[i].split(b"\n")
        same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
        top = max(distinct.values())
        out[i] = (
            np.log1p(n), sizes[i] / n, len(distinct) / n, same / n, top / n, share[2][row], share[3][row], share[4][row],
            share[5][row], share[6][row], share[7][row], np.log1p(n / len(lines)), len(set(lines)) / len(lines),
            capitals[row] / n, share["doubled"][row],
        )
    return out


def _leaves(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Step per bin of a tree of this depth over ordered bins with gradient sums ``g`` and curvature sums ``h``."""
    value = np.full(len(g), g.sum() / (h.sum() + SHRINK))
    if depth == 0 or len(g) < 2:
        return value
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + SHRINK) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + SHRINK)
    cut = int(np.argmax(gain)) + 1
    if gain[cut - 1] <= g.sum() ** 2 / (h.sum() + SHRINK) + 1e-9:
        return value
    return np.concatenate((_leaves(g[:cut], h[:cut], depth - 1), _leaves(g[cut:], h[cut:], depth - 1)))


def _fields(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step per cell of the best cut of a table into four fields."""

    def corner(x):
        return np.cumsum(np.cumsum(x, 0), 1)

    cg, ch = corner(g), corner(h)

    def parts(c):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        return np.stack([a, b, d, c[-1, -1] - a - b - d])

    pg, ph = parts(cg), parts(ch)
    gain = (pg**2 / (ph + SHRINK)).sum(0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.empty_like(g)
    value = pg[:, i, j] / (ph[:, i, j] + SHRINK)
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), step


@dataclass
class AdditiveModel:
    """Lookup tables over bins."""

    intercept: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[k], x[:, k], side="right")]
        coarse = {k: np.searchsorted(self.pair_cuts[k], x[:, k], side="right") for p in self.pairs for k in p}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return total

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(features(texts))))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Train on feature rows and 0/1 labels."""
    if not len(y):
        return AdditiveModel(0.0)
    rate = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    model = AdditiveModel(float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return model
    edges = lambda k, n: np.unique(np.quantile(x[:, k], np.arange(1, n) / n))
    model.cuts = [edges(k, BINS) for k in range(x.shape[1])]
    model.pair_cuts = [edges(k, PAIR_BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    coarse = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.pair_cuts)]
    logit = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = (np.bincount(b, v, len(model.tables[k])) for v in slopes())
            step = RATE * _leaves(g, h, 2)
            model.tables[k] += step
            logit += step[b]
    sizes = [len(c) + 1 for c in model.pair_cuts]
    cells = lambda i, j: coarse[i] * sizes[j] + coarse[j]
    table = lambda i, j, v: np.bincount(cells(i, j), v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    left = slopes()
    every = [(i, j) for i in range(len(sizes)) for j in range(i) if sizes[i] > 1 and sizes[j] > 1]
    gains = {p: _fields(*(table(*p, v) for v in left))[0] for p in every}
    model.pairs = sorted(every, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, pair in enumerate(model.pairs):
            step = RATE * _fields(*(table(*pair, v) for v in slopes()))[1]
            model.pair_tables[k] += step
            logit += step.ravel()[cells(*pair)]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> AdditiveModel:
    """The model from labelled rows outside the held-out fold."""
    rows = training_sample(docs, labels, label, per_class)
    parts = [features(b) for b in blocks(rows["text"].tolist(), 1 << 21)]
    x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
    return fit(x, rows["label"].to_numpy(dtype=float))


def quality_scores(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    return scored(docs, scorer(lambda: model.scores), threshold)


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    return docs.where(scorer(lambda: model.scores)(text_of()) >= F.lit(threshold))
