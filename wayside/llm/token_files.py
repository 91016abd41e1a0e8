"""Token ids in Arrow files of fixed-size lists.

Documents go in ascending order of their id into buckets, a bucket into a file of the Arrow file format. The ids of a
file, each document closed by an end id, fill sequences of ``LENGTH`` ids; only the last one is padded. A record batch
holds up to ``SEQUENCES`` of them as ``ids: fixed_size_list<uint16 or uint32>`` and ``mask: fixed_size_list<bool>``, true
where an id counts, uncompressed: sequence ``i`` of a file is a slice of the mapped file. An index table names file, first
position and length for every document. A file is written under a name of its own by each attempt, and only files of
attempts that succeeded are in the index, so a lost executor leaves no wrong rows.

Edge cases: an empty or null text has only the end id; rows without ``doc_id`` come first; rows of the same id follow in
the order of a hash of their text; extra columns are ignored; an empty table writes no file and gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, functions as F

from wayside.llm.common import staged, width
from wayside.llm.ordered import bounds, in_order
from wayside.llm.tokens import encoder
from wayside.session import scratch_path

LENGTH, SEQUENCES, END = 2048, 256, 1
INDEX = "bucket int, file string, doc_id bigint, first bigint, n_tokens bigint"


class SequenceWriter:
    """Packs ids into equal sequences and writes them to one file."""

    def __init__(self, path: str, dtype: np.dtype, length: int = LENGTH, sequences: int = SEQUENCES):
        system, place = fs.FileSystem.from_uri(path)
        self.dtype, self.length, self.room = dtype, length, length * sequences
        item = pa.field("item", pa.from_numpy_dtype(dtype), nullable=False)
        self.schema = pa.schema(
            [("ids", pa.list_(item, length)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))]
        )
        self.out = system.open_output_stream(place)
        self.file = ipc.new_file(self.out, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.total = 0

    def add(self, ids: np.ndarray) -> int:
        """Append a document; its first position in the file."""
        first = self.total
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.room:
            self._flush(last=False)
        return first

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        whole = len(flat) if last else len(flat) - len(flat) % self.room
        for at in range(0, whole, self.room):
            part = flat[at : min(whole, at + self.room)]
            n = -(-len(part) // self.length) * self.length
            ids, mask = np.zeros(n, self.dtype), np.zeros(n, bool)
            ids[: len(part)], mask[: len(part)] = part, True
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(x), type=t.type) for x, t in zip((ids, mask), self.schema)
            ]
            self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.held = [flat[whole:]] if whole < len(flat) else []
        self.size = len(flat) - whole

    def close(self) -> None:
        self._flush(last=True)
        self.file.close()
        self.out.close()


class SequenceReader:
    """Random access to the ids of a file."""

    def __init__(self, path: str):
        system, place = fs.FileSystem.from_uri(path)
        source = pa.memory_map(place) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(place)
        self.file = ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.per_batch = len(self.file.get_batch(0)) * self.length if self.file.num_record_batches else 0
        self.at, self.flat = -1, None

    def _batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.flat = k, self.file.get_batch(k).column(0).values.to_numpy(zero_copy_only=True)
        return self.flat

    def ids(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from a position on: a view where they lie in one batch."""
        parts = []
        while count:
            k, skip = divmod(first, self.per_batch)
            part = self._batch(k)[skip : skip + count]
            parts.append(part)
            first, count = first + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Encode and write all documents below ``folder``; the index ``bucket, file, doc_id, first, n_tokens``."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    partitions = width(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        close = np.array([end], dtype=words.dtype)
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        writer, at, name = None, None, ""
        for batch in batches:
            rows = []
            for bucket, doc_id, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
                if bucket != at:
                    if writer:
                        writer.close()
                    at, name = bucket, f"{folder}/part-{bucket:06d}-{uuid.uuid4().hex}.arrow"
                    writer = SequenceWriter(name, words.dtype, length)
                ids = np.concatenate((words.encode(text), close))
                rows.append((bucket, name, doc_id, writer.add(ids), len(ids)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["bucket", "file", "doc_id", "first", "n_tokens"],
                )
        if writer:
            writer.close()

    at = bounds(docs, 2 * partitions)
    return staged(in_order(docs, at, partitions).mapInArrow(write, INDEX), "token-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start`` is the position in the whole sequence of files: one number per file is added up on the driver.
    """
    totals = sorted((r["bucket"], r["n"]) for r in index.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect())
    base, ahead = {}, 0
    for bucket, n in totals:
        base[bucket], ahead = ahead, ahead + n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for batch in batches:
            sums, starts = [], []
            for bucket, file, _, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    reader, name = SequenceReader(file), file
                sums.append(zlib.crc32(reader.ids(first, n).astype("<u4").tobytes()))
                starts.append(base[bucket] + first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(starts, pa.int64()), batch.column(4), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return index.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
