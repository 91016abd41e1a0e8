"""Allow and block rules for urls by a sort-merge range join.

A host is written with its labels reversed and a dot after each (``a.example.net`` becomes
``net.example.a.``), so that a host and all its subdomains are the interval from ``net.example.`` up to
``net.example/`` (the slash follows the dot and is in no host). Intervals of rules nest or are apart. One sorted
sweep over rule starts, rule ends and urls carries the stack of the rules whose interval is open; of
these the longest whose path fits decides.

Rows are swept in groups of one top label and a salt. The number of salts of a label follows its share of the
urls, so a hot label or host is spread over many tasks; only rules of that label are repeated for each salt.

Edge cases: a null url or one without ``://`` has an empty host and path and fits no rule; hosts are compared
with A-Z lower-cased and may hold ports, which then count as part of the last label; repeated urls are judged
each; of two equal rules a block wins; a rule without host is refused; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayside.llm.common import width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: host, path, verdict
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, a dot after each."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _stacks(rules: DataFrame) -> DataFrame:
    """For each rule host its interval and the rules of it and of the hosts above: ``lo, hi, opened, closed``."""
    per_host = rules.groupBy("host").agg(F.collect_set(F.struct("host", "path", "verdict")).alias("own"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    chain = (
        per_host.select("host", F.posexplode(above).alias("up", "ancestor"))
        .join(per_host.select(F.col("host").alias("ancestor"), "own"), "ancestor")
        .groupBy("host")
        .agg(
            F.flatten(F.collect_list("own")).alias("opened"),
            F.flatten(F.collect_list(F.when(F.col("up") > 0, F.col("own")))).alias("closed"),
        )
    )
    key = host_key(F.col("host"))
    return chain.select(
        key.alias("lo"), F.concat(key.substr(F.lit(1), F.length(key) - 1), F.lit("/")).alias("hi"), "opened", "closed"
    )


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """The rows of ``pages`` with ``host, path, rule, verdict`` added (replacing columns of these names).

    ``rules`` has host, path and verdict. The stack holds the rules of the host and the hosts above it, so its
    size is that of the rules of one branch.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).where("host <> ''")
    stacks = _stacks(rules)
    top = F.substring_index("key", ".", 1)

    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    urls = pages.select(
        F.struct(*names).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    ).withColumn("key", host_key(F.col("host"))).withColumn("top", top)
    counts = pages.select(host_key(host_of(F.col(url))).alias("key")).groupBy(top.alias("top")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    share = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(2 * width(spark)) / total)).cast("int")
    salts = counts.select("top", share.alias("salts"))

    # The salt of a url follows its text, so that repeats of the work deal it out alike.
    events = stacks.withColumns({"top": F.substring_index("lo", ".", 1)}).join(salts, "top").select(
        "top", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "lo", "hi", "opened", "closed"
    )
    dealt = urls.join(salts, "top").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).drop("salts")
    starts = events.select("top", "salt", F.col("lo").alias("key"), F.lit(0).alias("turn"), F.col("opened").alias("stack"))
    ends = events.select("top", "salt", F.col("hi").alias("key"), F.lit(0).alias("turn"), F.col("closed").alias("stack"))
    sweep = Window.partitionBy("top", "salt").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        dealt.withColumn("turn", F.lit(1))
        .unionByName(starts.unionByName(ends), allowMissingColumns=True)
        # Rows dealt out by label alone would do for the sweep, too; then salts would not spread anything.
        .repartition("top", "salt")
        .withColumn("stack", F.last("stack", ignorenulls=True).over(sweep))
        .where("turn = 1")
    )
    fitting = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(
        fitting,
        lambda r: F.struct(
            (F.length(r["host"]) + F.length(r["path"])).alias("size"), (r["verdict"] == "block").alias("strict"),
            r["host"].alias("host"), r["path"].alias("path"), r["verdict"].alias("verdict"),
        ),
    )
    best = F.array_max(ranked)
    return swept.withColumn("best", best).select(
        *[F.col("row")[c].alias(c) for c in names], "host", "path",
        F.concat("best.host", F.when(F.col("best.path") == "", "/").otherwise(F.col("best.path"))).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
