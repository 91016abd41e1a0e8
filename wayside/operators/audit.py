"""Feed versions, manifests and the daily digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import gtfs_date
from ..functions.ratios import zero_key
from ..schemas import DIMENSIONS, conform
from .keys import assign_keys, narrow
from .latest import keep_latest


def feed_hash(content: str = "content"):
    """SHA-256 of a feed's bytes or text."""
    return F.sha2(F.col(content).cast("binary"), 256)


def is_new_version(feeds: DataFrame, versions: DataFrame) -> DataFrame:
    """Feeds whose hash is not registered yet; the others need no processing."""
    return feeds.join(versions.select("feedhash"), "feedhash", "left_anti").select(*feeds.columns)


def register_feed_version(versions: DataFrame, feeds: DataFrame) -> DataFrame:
    """Version table after ingesting ``feeds`` (feedhash, ingestedat and optional descriptive columns).

    A known hash keeps its key and changes nothing. New hashes get keys counting on from the
    maximum; the last one ingested becomes current and every other row loses the flag.
    """
    fresh = is_new_version(feeds, versions)
    first_seen = F.min(F.struct("ingestedat", *[c for c in feeds.columns if c not in ("feedhash", "ingestedat")]))
    fresh = fresh.groupBy("feedhash").agg(first_seen.alias("_f"))
    fresh = fresh.select("feedhash", *[F.col(f"_f.{c}").alias(c) for c in feeds.columns if c != "feedhash"])
    highest = zero_key(versions.agg(F.max("versionkey")).scalar())
    last_hash = fresh.agg(F.max(F.struct("ingestedat", "feedhash")).alias("_m")).select("_m.feedhash").scalar()
    added = assign_keys(fresh, ["feedhash"], "versionkey", highest)
    added = added.withColumns({"iscurrent": F.col("feedhash") == last_hash, "isactive": F.lit(True)})
    kept = versions.withColumn("iscurrent", F.col("iscurrent") & last_hash.isNull())
    return conform(kept, DIMENSIONS["feed_version"]).unionByName(conform(added, DIMENSIONS["feed_version"]))


def describe_feed(feed_info: DataFrame) -> DataFrame:
    """Descriptive columns of a feed version from its feed_info record."""
    return feed_info.select(
        gtfs_date("feed_start_date").alias("feedstartdate"),
        gtfs_date("feed_end_date").alias("feedenddate"),
        F.col("feed_publisher_name").alias("feedpublishername"),
        F.col("feed_version").alias("feedversion"),
    )


def latest_manifest(manifests: DataFrame, as_of) -> DataFrame:
    """Per feed the last manifest before ``as_of``, marked as a fallback for that day."""
    day = F.lit(as_of).cast("date")
    earlier = manifests.filter(F.col("load_date") < day)
    rest = [c for c in manifests.columns if c not in ("feed_key", "load_date")]
    last = earlier.groupBy("feed_key").agg(F.max(F.struct("load_date", *rest)).alias("_m"))
    return last.select(
        "feed_key",
        day.alias("load_date"),
        *[(F.lit(False) if c == "is_new_version" else F.col(f"_m.{c}")).alias(c) for c in rest],
        F.lit(True).alias("fallback"),
        F.col("_m.load_date").alias("fallback_date"),
    )


def daily_digest(runs: DataFrame, validations: DataFrame, fallbacks: DataFrame, versions_seen: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per date of ``dates`` (run_date): last run, feed version, validation, fallback and headline.

    ``versions_seen`` is matched by the date the hash was last seen.
    """
    spine = dates.select("run_date").distinct()
    run = keep_latest(narrow(runs, "run_date", spine), ["run_date"], ["run_timestamp"])
    run = run.select("run_date", "status", "run_timestamp", "is_new_version", "file_count", "error")
    checks = narrow(validations, "run_date", spine).groupBy("run_date").agg(
        F.max(F.struct("overall_passed", "passed", "total_tables")).alias("_v")
    )
    used = narrow(fallbacks, "run_date", spine).groupBy("run_date").agg(F.min("fallback_date").alias("fallback_date"))
    seen = narrow(versions_seen.withColumnRenamed("last_seen_date", "run_date"), "run_date", spine)
    seen = seen.groupBy("run_date").agg(F.max("feedhash").alias("feedhash"))
    joined = spine
    for part in (run, checks, used, seen):
        joined = joined.join(part, "run_date", "left")
    status = F.coalesce("status", F.lit("UNKNOWN"))
    valid = F.coalesce("_v.overall_passed", F.lit(False))
    succeeded = status == "SUCCEEDED"
    return joined.select(
        "run_date",
        status.alias("run_status"),
        "run_timestamp",
        F.coalesce("is_new_version", F.lit(False)).alias("is_new_version"),
        F.coalesce("file_count", F.lit(0)).alias("file_count"),
        "error",
        F.coalesce("feedhash", F.lit("UNKNOWN")).alias("feed_hash"),
        valid.alias("validation_passed"),
        F.coalesce("_v.passed", F.lit(0)).alias("tables_passed"),
        F.coalesce("_v.total_tables", F.lit(0)).alias("tables_total"),
        F.col("fallback_date").isNotNull().alias("fallback_used"),
        "fallback_date",
        F.when(succeeded & valid, "OK").when(succeeded, "ISSUES").otherwise("FAILED").alias("headline"),
    )
