"""Exact deduplication by a stateful stream over digests.

The stream groups by the digest of the normalised text. Its state lives in RocksDB, never expires, and
holds for each digest the stable identifier (smallest ``doc_id``), the locator of that row's content
(file and row within it) and how many rows had the digest. Afterwards every hit, a row whose digest
was there already, is compared byte by byte with the text behind the locator; rows that share a digest
but not the text form groups of their own. The state folder can be reused: a later run over more
files continues from it. The comparison deals out a large group of copies in slices, each with a copy of the keeper.

Edge cases: a null text counts as empty; rows without ``doc_id`` come after all others; of rows with the
same id and text the first by locator stays; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wayside.llm.common import BLANKS, settings, staged, text_of
from wayside.session import scratch_path

#: Settings of the state store: on local disk with a write-ahead log in the checkpoint folder.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # Many small stores would each set aside megabytes of disk for their logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

IDENT = "doc_id bigint, file string, line bigint"

#: Copies that one copy of their keeper's text is compared with; larger groups are salted.
COPIES = 256


def normalised(column: str = "text") -> Column:
    """The text with every run of white space replaced by one space."""
    return F.regexp_replace(text_of(column), BLANKS, " ")


def sha256(text: Column) -> Column:
    """Binary SHA-256 of a text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and where the row is stored; frames that do not read files are stored first."""
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line"))
    try:
        return docs.select("doc_id", "text", *place)
    except AnalysisException:
        return staged(docs.select("doc_id", "text"), "dedup-rows").select("doc_id", "text", *place)


def observe(spark: SparkSession, digests: str, state: str, files_per_batch: int | None = None) -> None:
    """Feed the files below ``digests`` that the state has not seen yet into it."""
    reader = spark.readStream.schema(f"digest binary, {IDENT}")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    ident = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "line")
    seen = reader.parquet(digests).groupBy("digest").agg(F.min(ident).alias("keeper"), F.count("*").alias("n"))
    with settings(spark, STATE_CONF):
        query = (
            seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()


def remembered(spark: SparkSession, state: str) -> DataFrame:
    """What the state holds: ``digest``, ``keeper`` and ``n``."""
    with settings(spark, STATE_CONF):
        store = spark.read.format("statestore").load(state)
    keeper, n = store.schema["value"].dataType.names[:2]
    return store.select(
        F.col("key")[store.schema["key"].dataType.names[0]].alias("digest"),
        F.col("value")[keeper].alias("keeper"), F.col("value")[n].alias("n"),
    )


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, file, line, keep_id, group_size, kept, digest``.

    ``digest`` maps the normalised text to a binary key; any function is right, a weak one only makes
    more byte comparisons.
    """
    spark = docs.sparkSession
    rows = located(docs)
    digests, state = scratch_path(spark, "dedup-digests"), state or scratch_path(spark, "dedup-state")
    rows.select(digest(normalised()).alias("digest"), "doc_id", "file", "line").write.parquet(digests)
    observe(spark, digests, state)
    mine = spark.read.schema(f"digest binary, {IDENT}").parquet(digests)
    members = mine.join(staged(remembered(spark, state), "dedup-seen"), "digest")
    same_row = (F.col("file") == F.col("keeper.file")) & (F.col("line") == F.col("keeper.line"))

    shared = members.where("n > 1").select("file", "line", "digest", "n", same_row.alias("first"))
    texts = staged(
        rows.select("file", "line", "doc_id", normalised().alias("body")).join(shared, ["file", "line"]), "dedup-hits"
    )
    # A digest with many copies is compared in slices, each with a copy of the keeper's text.
    slices = F.ceil(F.col("n") / COPIES)
    hits = texts.where("not first").withColumn("slice", F.pmod(F.xxhash64("file", "line"), slices))
    keepers = texts.where("first").select(
        "digest", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)).alias("slice"), F.col("body").alias("kept_body")
    )
    other = hits.join(keepers, ["digest", "slice"]).where("body <> kept_body").drop("kept_body", "first", "n", "slice")
    ident = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "file", "line")
    regrouped = other.groupBy("digest", "body").agg(F.min(ident).alias("own"), F.count("*").alias("own_n"))
    strays = staged(
        other.join(regrouped, ["digest", "body"]).select("digest", "file", "line", "own", "own_n"), "dedup-strays"
    )
    fewer = strays.groupBy("digest").agg(F.count("*").alias("gone"))
    joined = members.join(strays.drop("digest"), ["file", "line"], "left").join(fewer, "digest", "left")
    keeper = F.coalesce("own", "keeper")
    return joined.select(
        "doc_id", "file", "line", keeper["doc_id"].alias("keep_id"),
        F.coalesce("own_n", F.col("n") - F.coalesce("gone", F.lit(0))).alias("group_size"),
        ((F.col("file") == keeper["file"]) & (F.col("line") == keeper["line"])).alias("kept"), "digest",
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    spark = docs.sparkSession
    try:
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line")]
        rows = docs.select(F.struct("*").alias("document"), *place)
    except AnalysisException:
        return drop_exact(staged(docs, "dedup-rows"))
    kept = exact_groups(docs).where("kept").select("file", "line")
    return rows.join(kept, ["file", "line"], "left_semi").select("document.*")
