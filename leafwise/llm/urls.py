"""URL filters by a sort-merge range join (operator 5), in DataFrame functions alone.

A host's labels in reverse, each closed by a dot, make a canonical key under
which a host and its subdomains form one interval. Hosts and rules are range
partitioned and sorted by that key together; sweeping through them, the last
rule met carries the stack of the rules that are still open around it. Where a
partition begins, the sweep starts with the stack left by those before it.

Only distinct hosts are swept, so a host with a third of all pages is one row,
and range partitions stay even however many hosts a domain has.

Defined results: a null url, or one without `://`, has an empty host and path
and no rule; then the verdict is the default. Repeated rows give repeated rows;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import spool, table

#: Fixed values: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Lower-cased authority after the first `://`; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by a dot: `a.example.com` -> `com.example.a.`"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def host_stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, stack: for each distinct host the rules (array of struct host, path, verdict) around it, innermost host first.

    `rules`: verdict, host, path.
    """
    entry = F.struct(F.length("host").alias("host_len"), F.length("path").alias("path_len"), "host", "path", "verdict")
    nodes = rules.select(host_key(F.col("host")).alias("key"), entry.alias("entry")).groupBy("key").agg(F.collect_set("entry").alias("own"))
    # A rule host's enclosing hosts are its key's beginnings at dots: few per rule, found by an equal join.
    up = nodes.select("key", F.explode(F.expr("transform(sequence(1, size(split(key, '[.]')) - 1), n -> concat(substring_index(key, '.', n), '.'))")).alias("outer"))
    stacks = up.join(nodes.withColumnRenamed("key", "outer"), "outer").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))
    swept = hosts.select(host_key(F.col("host")).alias("key"), "host", F.lit(1).alias("is_host"), F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    met = swept.unionByName(stacks.select("key", F.lit(None).cast("string").alias("host"), F.lit(0).alias("is_host"), "stack"))
    met = spool(met.repartitionByRange("key").sortWithinPartitions("key", "is_host").withColumn("part", F.spark_partition_id()))
    # The rule each partition ends with, carried over to the next ones: one row per partition.
    ends = met.filter("is_host = 0").groupBy("part").agg(F.max_by(F.struct("key", "stack"), "key").alias("end"))
    parts = met.select("part").distinct().join(ends, "part", "left")
    before = parts.select("part", F.last("end", ignorenulls=True).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    inside = met.withColumn("open", F.last(F.when(F.col("is_host") == 0, F.struct("key", "stack")), ignorenulls=True).over(W.partitionBy("part").orderBy("key", "is_host").rowsBetween(W.unboundedPreceding, W.currentRow)))
    # (part, key) order makes the window run through a sorted partition once.
    seen = inside.filter("is_host = 1").join(before, "part", "left").select("host", "key", F.coalesce("open", "carried").alias("open"))
    covers = F.filter("open.stack", lambda r: F.col("key").startswith(host_key(r["host"])))
    return seen.select("host", F.coalesce(covers, F.expr("array()").cast(stacks.schema["stack"].dataType)).alias("stack"))


def filter_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every page. The rule with the longest host wins, then the longest path."""
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    hosts = urls.select("host").distinct().filter("host <> ''")
    judged = urls.join(host_stacks(hosts, rules), "host", "left")
    best = F.array_max(F.filter("stack", lambda r: F.col("path").startswith(r["path"])))
    return judged.withColumn("best", best).select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the fixed rules."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS rules(verdict, host, path)")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


ORACLE = r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
urls AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT u.page_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host) DESC, length(r.path) DESC) AS nr
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON u.page_id = f.page_id AND f.nr = 1
"""
