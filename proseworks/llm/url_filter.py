"""URL rules by a sort-merge range join, in DataFrame functions only.

A host is turned round label by label (``www.example.com`` becomes ``com.example.www.``), so
a host and all its subdomains are one interval of keys: those that begin with the rule's key.
Rules and URLs are ranged and sorted together by key. The sweep carries the stack of rules
opened so far: hosts are nested or disjoint, so each rule's own stack (its enclosing rules and
itself) is known when it opens, and a URL takes the stack of the last rule opened before it
and pops those whose interval has ended. Of the rules still active, the longest whose path
begins the URL's path decides.

Ranges are made by key, host and path, so that one very common host or rule spans several
ranges; each range starts with the stack that the ranges before it leave behind.

Defined cases: a null URL has empty host and path; without ``://`` both are empty; URLs that no
rule fits get ``default``; equal rules: block wins; rules with a null host, path or action are
left out; no pages or no rules work. The rule table may be as large as a table; it is never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseworks.llm.common import stored

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), *_LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """The labels turned round, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _stacks(rules: DataFrame) -> DataFrame:
    """A row for each distinct rule key, with the stack of rules that cover it.

    The keys that may enclose a key are its own prefixes that end in a dot, so the stack is an
    equi-join of those prefixes (as many as the host has labels) with the keys that have rules.
    """
    own = rules.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("path", "action", "name"))).alias("own")
    )
    labels = F.expr("slice(split(key, '[.]', -1), 1, size(split(key, '[.]', -1)) - 1)")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))))
    pairs = own.select("key", prefix.alias("open"))
    return (
        pairs.join(own.select(F.col("key").alias("open"), "own"), "open")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("open", "own"))).alias("stack"))
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has columns host, path, action.

    Columns of the pages that have these names are replaced.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = rules.where("host is not null and path is not null and action is not null").select(
        host_key(F.translate("host", *_LOWER)).alias("key"), "path", "action", F.concat("host", "path").alias("name")
    ).distinct()
    opened = _stacks(rules).select("key", F.lit(0).alias("kind"), "stack", F.lit("").alias("path"), F.lit(None).cast(pages.schema).alias("row"), F.lit("").alias("host"))
    rest = F.struct(*[F.col(c) for c in pages.columns])
    asked = pages.select(rest.alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).select(
        host_key(F.coalesce("host", F.lit(""))).alias("key"), F.lit(1).alias("kind"),
        F.lit(None).cast(opened.schema["stack"].dataType).alias("stack"), F.coalesce("path", F.lit("")).alias("path"), "row", F.coalesce("host", F.lit("")).alias("host"),
    )
    events = opened.unionByName(asked)
    ranged = stored(
        events.repartitionByRange(ranges, "key", "kind", "path", F.xxhash64("row")).withColumn("range", F.spark_partition_id()), "url-events"
    )
    # The last rule opened in each range; one row a range, so the carry runs over few rows.
    last = ranged.where("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("stack")).withColumnRenamed("range", "at")
    ids = ranged.select("range").distinct()
    carried = ids.join(F.broadcast(last), F.col("at") < F.col("range"), "left").groupBy("range").agg(F.max_by("stack", "at").alias("carry"))
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        ranged.join(F.broadcast(carried), "range")
        .withColumn("open", F.coalesce(F.last("stack", ignorenulls=True).over(sweep), "carry"))
        .where("kind = 1")
    )
    active = F.filter(F.coalesce("open", F.array().cast(opened.schema["stack"].dataType)), lambda s: F.col("key").startswith(s["open"]))
    fitting = F.flatten(
        F.transform(active, lambda s: F.transform(F.filter(s["own"], lambda r: F.col("path").startswith(r["path"])), lambda r: F.struct(F.length(r["name"]).alias("size"), r["action"].alias("action"), r["name"].alias("name"))))
    )
    best = F.array_max(fitting)
    keep = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return swept.withColumn("best", best).select(
        *keep, "host", "path", F.col("best")["name"].alias("rule"), F.coalesce(F.col("best")["action"], F.lit(default)).alias("verdict")
    )
