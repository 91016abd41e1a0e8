"""Alignment of two tokenizers' tokens over the same bytes.

A text, with a space before it, is encoded by a byte-level BPE (A) and a piece BPE with byte fallback (B). Byte offsets at which tokens of
both end are cuts; the tokens between neighbouring cuts are a group, and every A token of a group is linked with every B token of it.

Cuts are found by divide and conquer: in an interval of tokens the common end nearest to the middle is located by bisecting
B's ends, and both halves are treated alike; an interval without a common end is a group. All intervals of a block of
documents go one level down together. A pair of ids counts once for every document that holds it linked.

Documents are read in chunks. A chunk keeps its distinct id pairs, how many of its documents hold each, and for each document
the places of its pairs among them. The pairs' counts are summed over all chunks and joined back to the chunks that hold
them, so a frequent pair is one row per chunk and nothing is broadcast.

Edge cases: a null or empty text, and one that either tokenizer does not give back byte for byte, has no tokens; special
tokens written in a text are plain text; rows of the same id (or without one) each come out; extra columns are ignored; an
empty table gives no rows. Groups of many tokens are counted by distinct ids, so work does not grow with their product. The memory of a task holds a
chunk's distinct pairs and the tokens of its longest text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from wayside.llm.common import LARGE_ROWS, SHORT_BATCHES, settings, staged, text_of
from wayside.llm.lexicon import arrow_schema, batched, pack, unpack

#: Bytes of text in a chunk, and in a block that is aligned at once.
CHUNK_BYTES, BLOCK_BYTES = 8 << 20, 1 << 20
#: Groups with more links than this are counted by distinct ids.
WIDE = 256
#: How a byte-level vocabulary pre-splits texts (the public pattern of such vocabularies).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters in which a byte-level vocabulary writes bytes: printable ones as they are, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(others)}}


class ByteTokens:
    """A byte-level BPE read from its json file; ids are ranks of merges, which is checked."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, letters = content["model"], byte_letters()
        special = {t["content"] for t in content["added_tokens"]}
        named = {bytes(letters[c] for c in p): i for p, i in model["vocab"].items() if p not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = np.array([model["vocab"]["".join(m)] for m in merges], np.int64)
        if (np.diff(ids) <= 0).any():
            raise ValueError("the ids of the vocabulary are not in order of its merges")
        self.core = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=named, special_tokens={})
        self.size = max(model["vocab"].values()) + 1
        self.pieces = [b""] * self.size
        for piece, i in named.items():
            self.pieces[i] = piece

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text with a space before it."""
        return self.core.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)


class PieceTokens:
    """A piece BPE with byte fallback, which itself puts a space before a text."""

    def __init__(self, path: str):
        self.core = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.core.get_piece_size()
        self.pieces = [
            bytes([int(self.core.id_to_piece(i)[3:5], 16)]) if self.core.is_byte(i) else self.core.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.size)
        ]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.core.encode(text), np.int64)


_LOADED: dict[tuple[type, str], ByteTokens | PieceTokens] = {}


def loaded(kind: type, path: str):
    """A tokenizer, loaded once per Python worker."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the given numbers of places."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places in ``a_ends`` of the ends that ``b_ends`` has, too; ``bounds`` are places known to be cuts (the last of all among them)."""

    def shared(at: np.ndarray) -> np.ndarray:
        ends = a_ends[at]
        return b_ends[np.searchsorted(b_ends, ends)] == ends  # both have the last end of all

    def nearest(low: np.ndarray, high: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """The shared end nearest to each middle, or -1; intervals are probed in ever wider reach."""
        out, open_, reach = np.full(len(low), -1), np.arange(len(low)), 2
        while len(open_):
            mid = middle[open_]
            first, last = np.maximum(low[open_], mid - reach), np.minimum(high[open_], mid + reach + 1)
            counts = last - first
            at, owner = np.repeat(first, counts) + _places(counts), np.repeat(np.arange(len(open_)), counts)
            at, owner = at[hit := shared(at)], owner[hit]
            order = np.argsort(np.abs(at - mid[owner]), kind="stable")[::-1]
            out[open_[owner[order]]] = at[order]  # the nearest is written last
            done = (out[open_] >= 0) | ((first == low[open_]) & (last == high[open_]))
            open_, reach = open_[~done], 4 * reach
        return out

    low, high = np.concatenate(([0], bounds[:-1] + 1)), bounds  # tokens from low to high; high's end is a cut
    cuts = [bounds]
    while len(low := low[keep := low < high]):
        high = high[keep]
        cut = (low + high) // 2
        cut[cut == high] -= 1
        missed = np.flatnonzero(~shared(cut))
        cut[missed] = nearest(low[missed], high[missed], cut[missed])
        low, high, cut = (v[cut >= 0] for v in (low, high, cut))
        cuts.append(cut)
        low, high = np.stack((low, cut + 1), 1).ravel(), np.stack((cut, high), 1).ravel()
    return np.sort(np.concatenate(cuts))


@dataclass
class Aligned:
    """Tokens of some documents: ids, first token of each document, and last token of each group (in A and in B)."""

    a: np.ndarray
    b: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    ends: np.ndarray


def aligned(texts: list[str], first: ByteTokens, second: PieceTokens) -> Aligned:
    """Align some documents at once."""
    a, b = [], []
    none = np.zeros(0, np.int64)
    for text in texts:
        data = b" " + text.encode("utf-8", "replace") if text else b""
        x, y = (first.encode(text), second.encode(text)) if text else (none, none)
        same = b"".join(map(first.pieces.__getitem__, x.tolist())) == data == b"".join(map(second.pieces.__getitem__, y.tolist()))
        a.append(x if same else none)
        b.append(y if same else none)
    sizes = [np.array([len(p) for p in t.pieces], np.int64) for t in (first, second)]
    starts = [np.cumsum([0, *map(len, ids)]) for ids in (a, b)]
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    a_ends, b_ends = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
    last = np.unique(starts[0][1:])
    cuts = shared_cuts(a_ends, b_ends, last[last > 0] - 1) if len(a) else none
    return Aligned(a, b, *starts, cuts, np.searchsorted(b_ends, a_ends[cuts]) if len(a) else none, a_ends[cuts])


def _links(x: Aligned, a_size: int, b_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of document, A id and B id, and how often each is linked."""
    group_a, group_b = np.diff(x.a_cuts, prepend=-1), np.diff(x.b_cuts, prepend=-1)
    from_a, from_b = x.a_cuts + 1 - group_a, x.b_cuts + 1 - group_b
    doc = np.searchsorted(x.a_starts, x.a_cuts, side="right") - 1
    wide = group_a * group_b > WIDE
    n = np.where(wide, 0, group_a * group_b)
    within, owner = _places(n), np.repeat(np.arange(len(n)), n)
    beside = group_b[owner]
    a, b = x.a[from_a[owner] + within // beside], x.b[from_b[owner] + within % beside]
    keys, times = np.unique((doc[owner] * a_size + a) * b_size + b, return_counts=True)
    parts = []
    for g in np.flatnonzero(wide):
        a, of_a = np.unique(x.a[from_a[g] : x.a_cuts[g] + 1], return_counts=True)
        b, of_b = np.unique(x.b[from_b[g] : x.b_cuts[g] + 1], return_counts=True)
        parts.append((((doc[g] * a_size + a)[:, None] * b_size + b).ravel(), np.outer(of_a, of_b).ravel()))
    if parts:
        all_keys, all_times = (np.concatenate(c) for c in zip((keys, times), *parts))
        keys, where = np.unique(all_keys, return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, where, all_times)
    return keys, times


def _written(x: Aligned, shown: list[bytes], a_size: int, doc: int, groups: slice) -> str:
    """Digest of a document's groups, ``a1,a2|b1;a3|b2``; ``shown`` has every id followed by each of the three marks."""
    a0, a1, b0, b1 = *x.a_starts[doc : doc + 2], *x.b_starts[doc : doc + 2]
    if a0 == a1:
        return ""
    ends_a, ends_b = x.a_cuts[groups] - a0, x.b_cuts[groups] - b0
    mark_a, mark_b = np.zeros(a1 - a0, np.int64), np.zeros(b1 - b0, np.int64)
    mark_a[ends_a], mark_b[ends_b] = 1, 2
    # A group's A tokens come after the B tokens of all groups before it.
    groups_a, groups_b = np.diff(ends_a, prepend=-1), np.diff(ends_b, prepend=-1)
    at_a = np.arange(a1 - a0) + np.repeat(np.cumsum(groups_b) - groups_b, groups_a)
    at_b = np.arange(b1 - b0) + np.repeat(np.cumsum(groups_a), groups_b)
    codes = np.empty(len(at_a) + len(at_b), np.int64)
    codes[at_a] = 3 * x.a[a0:a1] + mark_a
    codes[at_b] = 3 * (x.b[b0:b1] + a_size) + mark_b
    return hashlib.sha256(b"".join(map(shown.__getitem__, codes.tolist()))[:-1]).hexdigest()


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of up to about ``most`` bytes; a longer text is a block of its own."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            if ids and size + len(text) > most:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if ids:
        yield ids, texts


CHUNK = (
    "chunk bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, n_pairs array<int>, places binary, a array<int>, b array<int>, held array<int>"
)
RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
)


def _chunks(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int) -> DataFrame:
    """One row per chunk: what its documents have, their pairs (``places``: steps between places in ``a, b`` and how often each is linked, compressed),
    and in how many of its documents each pair is."""
    schema = arrow_schema(docs, CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, second = loaded(ByteTokens, a_path), loaded(PieceTokens, b_path)
        base = first.size * second.size
        shown = [b"%d%b" % (i, mark) for n in (first.size, second.size) for i in range(n) for mark in (b",", b"|", b";")]
        serial, held, size = TaskContext.get().partitionId() << 32, [], 0

        def chunk() -> pa.RecordBatch:
            ids, a, b, groups, links, shas, counts = ([x for part in held for x in part[k]] for k in range(7))
            pairs = np.concatenate([part[7] for part in held])
            times = np.concatenate([part[8] for part in held])
            listed, where, often = np.unique(pairs, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            # Frequent pairs first, so that steps within a document are small.
            owner = np.repeat(np.arange(len(counts)), counts)
            places = rank[where]
            turn = np.lexsort((places, owner))
            places, times = places[turn], times[turn]
            steps = np.diff(places, prepend=0)
            heads = (np.cumsum(counts) - counts)[np.array(counts) > 0]
            steps[heads] = places[heads]
            listed = listed[order]
            packed = pack(steps.astype(np.int32), times.astype(np.int32))
            columns = ids, a, b, groups, links, shas, counts, packed, listed // second.size, listed % second.size, often[order]
            return pa.RecordBatch.from_arrays(
                [pa.array([serial], pa.int64()), *(pa.array([c], t) for c, t in zip(columns, schema.types[1:]))], schema=schema
            )

        for ids, texts in blocks(batches, BLOCK_BYTES):
            x = aligned(texts, first, second)
            keys, times = _links(x, first.size, second.size)
            doc = keys // base
            counts = np.bincount(doc, minlength=len(ids))
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, doc, times)
            edges = np.searchsorted(x.a_cuts, x.a_starts)  # first group of each document
            shas = [_written(x, shown, first.size, k, slice(edges[k], edges[k + 1])) for k in range(len(ids))]
            held.append((ids, np.diff(x.a_starts).tolist(), np.diff(x.b_starts).tolist(), np.diff(edges).tolist(), links.tolist(), shas, counts.tolist(), keys % base, times))
            size += sum(map(len, texts))
            if size > chunk_bytes:
                yield chunk()
                serial, held, size = serial + 1, [], 0
        if held:
            yield chunk()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, CHUNK)


def _counted(chunks: DataFrame) -> DataFrame:
    """``chunk, place, a, b, held``: the distinct pairs of every chunk."""
    return chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b", "held")).alias("place", "pair")).select("chunk", "place", "pair.*")


def _totals(pairs: DataFrame) -> DataFrame:
    """``a, b, count, best``: in how many documents each pair is linked, and the highest such number of its A id.

    An A id has at most as many partners as B has ids, which bounds the window."""
    total = pairs.groupBy("a", "b").agg(F.sum("held").alias("count"))
    return total.withColumn("best", F.max("count").over(Window.partitionBy("a")))


def _stored(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int) -> DataFrame:
    """The chunks, written. A task holds short batches of texts and a few chunks, however much it reads."""
    with settings(docs.sparkSession, SHORT_BATCHES):
        return staged(_chunks(docs, a_path, b_path, chunk_bytes), "align-chunks", LARGE_ROWS)


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``a, b, count, best`` of every linked pair of ids."""
    return _totals(_counted(_stored(docs, a_path, b_path, CHUNK_BYTES)))


def alignment(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    chunks = _stored(docs, a_path, b_path, chunk_bytes)
    pairs = staged(_counted(chunks), "align-pairs")
    totals = staged(_totals(pairs), "align-totals")
    known = pairs.join(totals, ["a", "b"]).select("chunk", "place", "count", (F.col("count") == F.col("best")).alias("is_best"))
    schema = arrow_schema(docs, RESULT)

    def finish(_, left: pa.Table, right: pa.Table) -> pa.Table:
        x = {name: left.column(name)[0].values for name in left.column_names[1:-1]}
        steps, times = (v.astype(np.int64) for v in unpack(left.column("places")[0].as_py(), np.int32, np.int32))
        count, best = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        place = right.column("place").to_numpy()
        count[place], best[place] = right.column("count").to_numpy(), right.column("is_best").to_numpy(zero_copy_only=False)
        sizes = x["n_pairs"].to_numpy()
        owner, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        through = np.cumsum(steps)
        before = np.append(0, through)[starts]
        at = through - before[owner]
        sums = []
        for values in (best, count):
            out = np.zeros(len(sizes), np.int64)
            np.add.at(out, owner, times * values[at])
            sums.append(pa.array(out))
        return pa.Table.from_arrays(
            [x["doc_id"], x["n_a"], x["n_b"], x["n_groups"], x["n_links"], *sums, x["groups_sha256"]], schema=schema
        )

    own = chunks.select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "places")
    return own.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(finish, RESULT)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, groups``: each group's byte range in the text with a space before it, and the ids of both tokenizers."""
    schema = "doc_id bigint, groups array<struct<start: bigint, end: bigint, a: array<int>, b: array<int>>>"
    arrow = arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = loaded(ByteTokens, a_path), loaded(PieceTokens, b_path)

        def rows():
            for ids, texts in blocks(batches, BLOCK_BYTES):
                x = aligned(texts, first, second)
                edges = np.searchsorted(x.a_cuts, x.a_starts)
                a, b = np.split(x.a, x.a_cuts + 1), np.split(x.b, x.b_cuts + 1)
                for k, doc_id in enumerate(ids):
                    own = range(edges[k], edges[k + 1])
                    base = x.ends[edges[k] - 1] if edges[k] else 0
                    starts = [0, *(x.ends[g] - base for g in own)]
                    yield doc_id, [
                        {"start": s, "end": e, "a": a[g].tolist(), "b": b[g].tolist()} for g, s, e in zip(own, starts, starts[1:])
                    ]

        yield from batched(rows(), arrow, 256)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)
