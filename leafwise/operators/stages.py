"""Durable stages: results by part, with a manifest that says of what they were made.

A stage is a function from rows to rows that works part by part. Its results are
stored under their part; the manifest holds, for each part, the digest of what it
was made from, the version of the function and the digest of what was stored.
Running it again makes those parts only that are missing, whose input or version
has changed, or whose stored rows are no longer what the manifest says. A run
that dies between the two writes leaves no entry, so its parts are made again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.sources.shared import exists

#: The digest of no rows.
NOTHING = "0:0:0"
#: Column of the stored rows that names the run which made them.
RUN = "_run"


def content_digest(rows: DataFrame, part: str, name: str) -> DataFrame:
    """part and the digest of its rows, whatever their order: a count, and the xor and sum of their 64-bit hashes (columns that hold maps have none). Pre-aggregated, so no part is gathered."""
    h = F.xxhash64(*[x for c in sorted(rows.columns) if c != part for x in (F.col(c).isNull(), F.col(c))])
    total = F.sum(h.cast("decimal(38,0)"))
    return rows.groupBy(part).agg(F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(h).cast("string"), total.cast("string")).alias(name))


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def manifest(spark: SparkSession, path: str, part: str, kind: str) -> DataFrame:
    """part, version, given, made, run of the last run that made each part."""
    log = _read(spark, f"{path}/manifest", f"{part} {kind}, version string, given string, made string, run int")
    last = F.max_by(F.struct("version", "given", "made", "run"), "run")
    return log.groupBy(part).agg(last.alias("m")).select(part, "m.*")


def stage(given: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, *, part: str = "part", version: str = "1") -> DataFrame:
    """The rows of make(given), of which only what is missing, changed or damaged is made now.

    `make` must give rows with the same `part` as those it made them from. The
    result holds the parts that `given` holds.
    """
    spark = given.sparkSession
    kind = dict(given.dtypes)[part]
    schema = make(given.limit(0)).withColumn(RUN, F.lit(0)).schema
    data = f"{path}/data"

    def stored(log: DataFrame) -> DataFrame:
        """The rows that the manifest names: of each part those of its last run (a part that is empty now may hold rows of an earlier one)."""
        return _read(spark, data, schema).join(log.select(part, F.col("run").alias(RUN)), [part, RUN], "left_semi").drop(RUN)

    log = manifest(spark, path, part, kind)
    now = content_digest(given, part, "given")
    found = content_digest(stored(log), part, "found")
    fresh = log.filter(F.col("version") == version).join(now, [part, "given"]).join(found, part, "left").filter(F.coalesce("found", F.lit(NOTHING)) == F.col("made"))
    # Written first: it says what was there before this run changes it.
    now.join(fresh.select(part), part, "left_anti").write.mode("overwrite").parquet(f"{path}/todo")
    todo = spark.read.schema(now.schema).parquet(f"{path}/todo")
    if not todo.isEmpty():
        run = (log.agg(F.max("run")).first()[0] or 0) + 1
        made = make(given.join(todo.select(part), part, "left_semi")).withColumn(RUN, F.lit(run))
        made.write.partitionBy(part).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(data)
        own = content_digest(stored(todo.withColumn("run", F.lit(run))), part, "made")
        entry = todo.join(own, part, "left").select(part, F.lit(version).alias("version"), "given", F.coalesce("made", F.lit(NOTHING)).alias("made"), F.lit(run).alias("run"))
        entry.write.mode("overwrite").parquet(f"{path}/manifest/n={run}")
    return stored(manifest(spark, path, part, kind).join(now.select(part), part, "left_semi"))
