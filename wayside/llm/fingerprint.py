"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols, its code points. One level of parsing merges runs of a symbol into one, lets each symbol
and its left neighbour toss deterministic coins (position and value of the lowest bit in which they differ; four rounds
bring any symbols down to six labels of which neighbours differ), starts a phrase at each local maximum of the labels and
names the phrase by a hash of its symbols. The names are the symbols of the next level, up to one name for the whole
text. Cuts depend on a few neighbours only, so equal passages have the same phrases inside, wherever they stand.

The fingerprint is the name of the whole text and the smallest ``SKETCH`` hashes of the phrase names of all levels,
whatever its length, so that any two sketches are of the same kinds of phrases.
Likeness is the estimated share of phrases in common (Dice); equal texts have likeness 1.

Edge cases: a null text counts as empty and has the name zero and no phrases, like 1 to another empty text and 0 to any
other; rows without ``doc_id`` come first; rows with the same id follow each other in the order of a hash of the text; a
single document is its own next; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayside.llm.common import width
from wayside.llm.ordered import bounds, in_order

SKETCH = 64
#: Code points parsed together.
BLOCK = 1 << 20

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread hash of 64-bit values."""
    x = x + _A
    x ^= x >> np.uint64(30)
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def _tosses() -> np.ndarray:
    """Label of a symbol below 128 (second index) whose left neighbour is the first index."""
    left, own = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    differ = left ^ own
    place = np.bitwise_count((differ & -differ) - 1)
    place[differ == 0] = 0
    return (2 * place + ((own >> place) & 1)).astype(np.uint8).ravel()


_TOSS = _tosses()


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six; ``first`` are the positions without a left neighbour. Neighbours must differ."""
    one = symbols.dtype.type(1)
    differ = symbols[1:] ^ symbols[:-1]
    low = differ & (~differ + one)
    place = np.bitwise_count(low - one)
    labels = np.empty(len(symbols), dtype=np.uint8)
    labels[1:] = 2 * place + ((symbols[1:] & low) != 0)
    labels[first] = symbols[first] & one
    for _ in range(3):
        pair = labels[:-1].astype(np.uint16)
        pair <<= np.uint16(7)
        pair |= labels[1:]
        start = labels[first] & 1
        labels = np.concatenate((labels[:1], _TOSS.take(pair)))
        labels[first] = start
    return labels


def parse(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of whole texts, and (text, phrase name) of all phrases."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    names = np.zeros(len(texts), dtype=np.uint64)
    owners, phrases = [], []
    open_ = np.flatnonzero(sizes)
    symbols = np.concatenate([texts[i] for i in open_]) if len(open_) else np.zeros(0, dtype=np.uint32)
    first = np.concatenate(([0], np.cumsum(sizes[open_])[:-1])) if len(open_) else np.zeros(0, dtype=np.int64)
    level = 0
    while len(open_):
        # Runs become one symbol.
        fresh = np.empty(len(symbols), dtype=bool)
        np.not_equal(symbols[1:], symbols[:-1], out=fresh[1:])
        fresh[first] = True
        at = np.flatnonzero(fresh)
        moved = np.cumsum(fresh)[first] - 1
        size = np.diff(np.append(at, len(symbols)))
        plain = symbols[at]
        named = _mixed(plain.astype(np.uint64))
        runs = np.flatnonzero(size > 1)
        named[runs] = _mixed(named[runs] ^ (size[runs].astype(np.uint64) * _C))
        first = moved
        labels = _labels(plain, first)  # neighbours differ, now that runs are one
        # Phrases start at local maxima.
        cut = np.zeros(len(labels), dtype=bool)
        cut[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
        cut[np.append(first[1:], len(labels)) - 1] = False
        cut[first] = True
        starts = np.flatnonzero(cut)
        inside = np.arange(len(labels)) - np.repeat(starts, np.diff(np.append(starts, len(labels))))
        part = _mixed(named ^ ((inside.astype(np.uint64) + np.uint64(1)) * _B))
        level += 1
        symbols = _mixed(np.add.reduceat(part, starts) ^ np.uint64(level))
        first = np.searchsorted(starts, first)
        count = np.diff(np.append(first, len(symbols)))
        done = count == 1
        owners.append(np.repeat(open_, count))
        phrases.append(symbols)
        names[open_[done]] = symbols[first[done]]
        symbols = symbols[np.repeat(~done, count)]
        open_, count = open_[~done], count[~done]
        first = np.concatenate(([0], np.cumsum(count)[:-1])) if len(open_) else first[:0]
    nothing = np.zeros(0, dtype=np.int64)
    return names, np.concatenate(owners or [nothing]), np.concatenate(phrases or [nothing.astype(np.uint64)])


Print = tuple[int, np.ndarray]


def prints(texts: list[np.ndarray], size: int = SKETCH) -> list[Print]:
    """Name and sketch (sorted, distinct, 32 bits each) of every text, given as code points."""
    names, owner, phrase = parse(texts)
    keys = np.unique((owner.astype(np.uint64) << np.uint64(32)) | (phrase >> np.uint64(32)))
    ends = np.searchsorted(keys, np.arange(1, len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    begins = np.concatenate(([0], ends[:-1]))
    low = keys.astype(np.uint32)
    return [(int(n), low[b : min(e, b + size)]) for n, b, e in zip(names, begins, ends)]


def shown(p: Print) -> str:
    """The fingerprint as text."""
    return f"{p[0]:016x}:{p[1].astype('>u4').tobytes().hex()}"


def likeness(p: Print, q: Print, size: int = SKETCH) -> float:
    """Estimated share of phrases in common, 0 to 1."""
    if p[0] == q[0]:
        return 1.0
    both = np.sort(np.concatenate((p[1], q[1])))
    if not len(both):
        return 0.0
    twice = both[1:] == both[:-1]
    union = both[np.concatenate(([True], ~twice))][:size]
    shared = int(np.count_nonzero(both[1:][twice] <= union[-1]))
    return 2 * shared / (len(union) + shared)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the head of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(pairs: list[tuple[int | None, str, str]]) -> Iterator[tuple]:
    changed = [edited(text, following) for _, text, following in pairs]
    every: dict[int, int] = {}
    texts: list[str] = []
    for text in (t for p in pairs for t in p[1:]):
        if id(text) not in every:
            every[id(text)] = len(texts)
            texts.append(text)
    found = prints([code_points(t) for t in texts + changed])
    for k, (doc_id, text, following) in enumerate(pairs):
        own, other, new = found[every[id(text)]], found[every[id(following)]], found[len(texts) + k]
        yield (
            doc_id, len(text), hashlib.sha256(changed[k].encode("utf-8", "surrogatepass")).hexdigest(),
            shown(own), shown(new), likeness(own, new), likeness(own, other),
        )


def _next_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """Each document with the text that follows it."""
    waiting = None
    for batch in batches:
        for guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
            if waiting is not None:
                yield (*waiting, text)
            waiting = None if guest else (doc_id, text)


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def block():
        columns = list(zip(*_rows(held)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SCHEMA.types)], schema=SCHEMA)

    for pair in _next_pairs(batches):
        held.append(pair)
        size += len(pair[1]) + 64
        if size > BLOCK:
            yield block()
            held, size = [], 0
    if held:
        yield block()


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every document."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            out, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
                    size, end = size + len(texts[end]), end + 1
                out += [shown(p) for p in prints([code_points(t) for t in texts[at:end]])]
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(compute, "doc_id bigint, fingerprint string")


def compared_with_edits(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``; the next document is that
    with the next higher id, the first after the last.
    """
    partitions = width(docs.sparkSession)
    at = bounds(docs, 4 * partitions)
    return in_order(docs, at, partitions, guests=True).mapInArrow(
        _compared,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
