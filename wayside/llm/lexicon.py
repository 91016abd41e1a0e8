"""Work on distinct words instead of words.

Tasks read documents in chunks. A chunk numbers its distinct words by falling frequency and keeps the documents as
compressed runs of these numbers. Its distinct words are dealt out over buckets by a hash of the word, so that one task
meets every word of a bucket, from all chunks, and can handle each once. The answers go back to their chunks, where they
are put in the words' places. A frequent word costs one entry per chunk, so no key is hot, and nothing is broadcast.

Two shuffles move these: per chunk and bucket one row of words, and the chunks together with the answers.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from wayside.llm.common import staged, width

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 32 << 20

SPLIT = "chunk bigint, bucket int, data binary, extra binary"
ANSWER = "chunk bigint, bucket int, data binary"


def squeeze(values: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes())


def unsqueeze(data: bytes, dtype=None):
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if dtype is None else np.frombuffer(raw, dtype=dtype)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary; integers of 32 bits as planes of bytes, of which the upper ones compress well."""
    out = []
    for a in arrays:
        if a.dtype == np.int32:
            a = a.view(np.uint8).reshape(-1, 4).T
            parts = [squeeze(plane) for plane in a]
        else:
            parts = [squeeze(a)]
        out += [np.array([len(p) for p in parts], dtype="<i8").tobytes(), *parts]
    return b"".join(out)


def unpack(data: bytes, *dtypes) -> list[np.ndarray]:
    out, at = [], 0
    for dtype in map(np.dtype, dtypes):
        planes = 4 if dtype == np.int32 else 1
        sizes = np.frombuffer(data, dtype="<i8", count=planes, offset=at)
        at += 8 * planes
        parts = []
        for n in sizes.tolist():
            parts.append(unsqueeze(data[at : at + n], np.uint8 if planes == 4 else dtype))
            at += n
        out.append(np.ascontiguousarray(np.stack(parts, 1)).view(np.int32).ravel() if planes == 4 else parts[0])
    return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def bucket_of(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) % np.uint32(buckets)


def split(
    docs: DataFrame, words: Callable[[], Callable[[str], list[bytes]]], counted: Callable[[int | None], bool] | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> tuple[DataFrame, DataFrame, int]:
    """The chunks and their words: two frames of a table in the shared folder, and the number of buckets.

    ``words`` makes the splitter of a text in the task; words hold no space. With ``counted`` the words' rows have in
    ``extra`` how often each is in documents whose id passes it.
    """
    buckets = width(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut, serial = words(), 0
        part = TaskContext.get().partitionId()
        numbers, ids, lengths, runs, size = _Numbers(), [], [], [], 0

        def chunk():
            nonlocal numbers, ids, lengths, runs, size, serial
            flat = np.concatenate(runs) if runs else np.zeros(0, np.int32)
            often = np.bincount(flat, minlength=len(numbers))
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            listed = list(numbers)
            listed = [listed[i] for i in order]
            lens = np.array(lengths, np.int64)
            bucket = bucket_of(listed, buckets)
            names = np.array([0 if i is None else i for i in ids], np.int64)
            known = np.array([i is not None for i in ids], np.uint8)
            body = pack(names, known, lens, rank[flat].astype(np.int32), bucket.astype(np.int32))
            key = (part << 32) + serial
            rows = [(key, -1, body, None)]
            if counted:
                inside = np.repeat(np.array([counted(i) for i in ids], bool), lens)
                counts = np.bincount(rank[flat[inside]], minlength=len(order)).astype(np.int32)
            by_bucket = np.argsort(bucket, kind="stable")
            for mine in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1) if len(by_bucket) else []:
                b = int(bucket[mine[0]])
                rows.append((key, b, squeeze(b" ".join([listed[i] for i in mine])), pack(counts[mine]) if counted else None))
            serial += 1
            numbers, ids, lengths, runs, size = _Numbers(), [], [], [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                names=["chunk", "bucket", "data", "extra"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = cut(text or "")
                if ids and size + len(text or "") > chunk_bytes:
                    yield chunk()
                ids.append(doc_id)
                lengths.append(len(found))
                runs.append(np.fromiter(map(numbers.__getitem__, found), dtype=np.int32, count=len(found)))
                size += len(text or "")
        if ids:
            yield chunk()

    table = staged(docs.select("doc_id", "text").mapInArrow(run, SPLIT), "lexicon")
    return table.where("bucket < 0").drop("extra"), table.where("bucket >= 0"), buckets


def answer(words: DataFrame, buckets: int, task: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str = ANSWER) -> DataFrame:
    """Apply ``task`` to the rows ``(chunk, bucket, words, extra)``; it yields rows of ``schema``. Whole buckets come together,
    unless ``buckets`` is 0, which leaves the rows where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for chunk, bucket, data, extra in zip(*(c.to_pylist() for c in batch.columns)):
                    yield chunk, bucket, unsqueeze(data).split(b" "), extra

        yield from batched(task(rows()), arrow)

    arrow = arrow_schema(words, schema)
    if buckets:
        words = words.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    return words.mapInArrow(run, schema)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    """The Arrow schema of a DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def assemble_chunks(
    chunks: DataFrame, answers: DataFrame, task: Callable[[list[tuple]], tuple | Iterator[tuple]], schema: str, held: int = 4096,
) -> DataFrame:
    """Bring answers back to the chunks. ``task`` gets the row of a chunk and then those of its answers in order of buckets,
    each ``(chunk, bucket, data)``, and returns a row of ``schema`` or an iterator of rows; ``held`` rows leave together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            held, at = [], None
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if row[0] != at:
                        if held:
                            yield held
                        held, at = [], row[0]
                    held.append(row)
            if held:
                yield held

        def rows():
            for group in groups():
                made = task(group)
                if isinstance(made, tuple):
                    yield made
                else:
                    yield from made

        yield from batched(rows(), arrow, 1 if "data binary" in schema else size)

    arrow, size = arrow_schema(chunks, schema), held
    both = chunks.unionByName(answers)
    # Chunks in turn instead of by a hash, so that no task gets several while others get none.
    turn = (F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(F.lit((1 << 32) - 1))).cast("int")
    dealt = both.repartitionById(width(chunks.sparkSession), turn)
    return dealt.sortWithinPartitions("chunk", "bucket").mapInArrow(run, schema)


def assemble(
    chunks: DataFrame, answers: DataFrame, task: Callable[[list[bytes], np.ndarray], Callable], schema: str, held: int = 4096,
) -> DataFrame:
    """Bring answers back to the chunks and make rows of documents.

    ``task`` gets the answers of a chunk in order of buckets and, for the words in that order, their numbers; it returns
    a function from a document's id and numbers to a row of ``schema``.
    """

    def documents(group: list[tuple]) -> Iterator[tuple]:
        ids, known, lens, flat, bucket = unpack(group[0][2], np.int64, np.uint8, np.int64, np.int32, np.int32)
        make = task([row[2] for row in group[1:]], np.argsort(bucket, kind="stable"))
        at = 0
        for doc_id, given, n in zip(ids.tolist(), known.tolist(), lens.tolist()):
            yield make(doc_id if given else None, flat[at : at + n])
            at += n

    return assemble_chunks(chunks, answers, documents, schema, held)
