"""BPE encoding and decoding with a table of distinct words.

Texts are split into words; each distinct word is encoded once by the tokenizer, and its ids return to all places of the
word. Decoding looks up the piece of every id in the tokenizer's table (fixed, one entry per id) and joins the pieces
with spaces, which is what a tokenizer without decoder does.

Edge cases: an empty or null text has no ids and decodes to the empty text; special tokens written in a text become their
ids, as the tokenizer has it; words of which the tokenizer drops everything have no ids; rows of the same id each come
out; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from wayside.llm.lexicon import CHUNK_BYTES, answer, assemble, pack, split, unpack
from wayside.llm.tokens import encoder

#: Documents with their texts that a task holds before it hands them on.
WHOLE_TEXTS = 256


def _each_word(vocabulary: str) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    def task(rows: Iterator[tuple]) -> Iterator[tuple]:
        words = encoder(vocabulary)
        at, seen = None, {}
        for chunk, bucket, listed, _ in rows:
            if bucket != at:
                at, seen = bucket, {}
            found = []
            for word in listed:
                ids = seen.get(word)
                if ids is None:
                    ids = seen[word] = words.__missing__(word)
                found.append(ids)
            item = words.dtype.itemsize
            sizes = np.fromiter(map(len, found), np.int32, len(found)) // item
            flat = np.frombuffer(b"".join(found), words.dtype).astype(np.int32)
            words.clear()
            yield chunk, bucket, pack(sizes.astype(np.int32), flat)

    return task


def _word_spans(answers: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a chunk's words in one array, and per number of a word where its ids start and how many they are."""
    parts = [unpack(a, np.int32, np.int32) for a in answers]
    first, size = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    if not parts:
        return np.zeros(0, np.int32), first, size
    sizes, flat = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    size[places] = sizes
    first[places] = np.cumsum(sizes, dtype=np.int64) - sizes
    return flat, first, size


def _word_ids(answers: list[bytes], places: np.ndarray) -> list[np.ndarray]:
    """The ids of each word by its number."""
    flat, first, size = _word_spans(answers, places)
    return [flat[at : at + n] for at, n in zip(first.tolist(), size.tolist())]


def _encode(docs: DataFrame, vocabulary: str, task: Callable, schema: str, chunk_bytes: int = CHUNK_BYTES, held: int = 4096) -> DataFrame:
    chunks, words, buckets = split(docs, lambda: encoder(vocabulary).words, chunk_bytes=chunk_bytes)
    return assemble(chunks, answer(words, buckets, _each_word(vocabulary)), task, schema, held)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids``."""

    def task(answers, places):
        ids = _word_ids(answers, places)
        return lambda doc_id, numbers: (doc_id, np.concatenate([ids[i] for i in numbers]).tolist() if len(numbers) else [])

    return _encode(docs, vocabulary, task, "doc_id bigint, ids array<int>")


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids, decoded`` with ids as text, joined by spaces: what goes in and what comes back."""
    return _encode(docs, vocabulary, _texts(vocabulary, lambda doc_id, n, ids, text: (doc_id, n, ids.decode(), text.decode())),
                   "doc_id bigint, n_tokens bigint, ids string, decoded string", CHUNK_BYTES // 2, WHOLE_TEXTS)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _encode(docs, vocabulary, _texts(vocabulary, lambda doc_id, n, ids, text: (doc_id, n, sha(ids), sha(text))),
                   "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _texts(vocabulary: str, row: Callable) -> Callable:
    def task(answers, places):
        pieces, decimal = encoder(vocabulary).pieces, encoder(vocabulary).decimal
        flat, first, sizes = _word_spans(answers, places)
        shown, spelt = [], []
        for at, n in zip(first.tolist(), sizes.tolist()):
            ids = flat[at : at + n].tolist()
            shown.append(b" ".join([decimal[i] for i in ids]))
            spelt.append(b" ".join([pieces[i] for i in ids]))

        def make(doc_id, numbers):
            n = sizes[numbers]
            some = numbers[n > 0].tolist()
            return row(doc_id, int(n.sum()), b" ".join([shown[i] for i in some]), b" ".join([spelt[i] for i in some]))

        return make

    return task
