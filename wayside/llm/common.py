"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayside.session import scratch_path, settings  # noqa: F401

#: White space of the contracts: space and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: For steps that hand texts to Python: few rows at a time, so that a batch is small in the reader, in what is sent, and in the worker.
SHORT_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.parquet.columnarReaderBatchSize": "256"}
#: For tables whose rows are large: a writer looks at its size after every row, not only after the hundredth, and a group of rows is small.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def staged(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that later steps neither repeat the
    work nor depend on executors that did it. ``options`` are those of the writer."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """How many partitions a shuffle makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, n: int) -> Column:
    """crc32 of the decimal id modulo ``n``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def row_digest(*columns: str) -> Column:
    """A value that orders equal ids the same way in every run."""
    return F.xxhash64(*columns)
