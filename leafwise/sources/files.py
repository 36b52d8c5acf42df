"""File sources and sinks, through Spark's readers and writers alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.functions.text import OFFICE_FORMATS, PAGE_FORMATS, extension
from leafwise.operators.ledger import verified


def scan(spark: SparkSession, path: str, *, recursive: bool = False, formats: Iterable[str] = (*PAGE_FORMATS, *OFFICE_FORMATS)) -> DataFrame:
    """path, length, modificationTime, content, sha256 of the supported files under `path`, by path. A folder without any raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    found = files.filter(extension("path").isin([f".{f}" for f in formats]))
    if found.select("path").isEmpty():
        raise FileNotFoundError(f"no supported files under {path}")
    return found.withColumn("sha256", F.sha2("content", 256)).orderBy("path")


def to_enqueue(files: DataFrame, priorities: Iterable[str] = ("normal", "urgent")) -> DataFrame:
    """path, priority: every file once for each priority."""
    return files.select("path", F.explode(F.array(*map(F.lit, priorities))).alias("priority"))


def newest(files: DataFrame) -> DataFrame:
    """The path of the file changed last."""
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def newest_field(files: DataFrame, field: str) -> DataFrame:
    """path, value: a field (a JSON path) of the file changed last, read as JSON."""
    last = files.agg(F.max_by(F.struct("path", "content"), F.struct("modificationTime", "path")).alias("f"))
    return last.select("f.path", F.get_json_object(F.col("f.content").cast("string"), field).alias("value"))


def words(pages: DataFrame, *, xml: str = "xml") -> DataFrame:
    """doc_id, page_idx, x_min, y_min, text of positional words in page XML (doc_id and a document of page and word elements)."""
    schema = "page array<struct<word:array<struct<_xMin:double,_yMin:double,_VALUE:string>>>>"
    bare = F.regexp_replace(F.regexp_replace(xml, r"(?s)<!DOCTYPE[^>]*>|\sxmlns=\"[^\"]*\"", ""), r"(?s)^.*?(<page\b.*</page>).*$", "<doc>$1</doc>")
    got = pages.select("doc_id", F.from_xml(bare, schema, {"attributePrefix": "_", "valueTag": "_VALUE"}).alias("d"))
    page = got.select("doc_id", F.posexplode("d.page").alias("page_idx", "p"))
    word = page.select("doc_id", "page_idx", F.explode("p.word").alias("w"))
    return word.select("doc_id", "page_idx", F.col("w._xMin").alias("x_min"), F.col("w._yMin").alias("y_min"), F.trim("w._VALUE").alias("text"))


def parse(files: DataFrame, provider: Callable, schema: str) -> DataFrame:
    """Blocks from file contents by a provider: a function from batches of rows to batches of blocks (layout models are plugged in here)."""
    return files.select("path", "content").mapInPandas(provider, schema)


def write_results(results: DataFrame, path: str) -> None:
    """Results (job_id, body), then their completion markers: a reader that asks for the marker never sees half a result.

    Each call writes a part of its own and marks what it has written itself, read
    back from there, so a second call marks no earlier result again.
    """
    part = uuid.uuid4().hex
    results.select("job_id", "body").write.parquet(f"{path}/results/part={part}")
    written = results.sparkSession.read.parquet(f"{path}/results/part={part}")
    written.select("job_id", F.sha2("body", 256).alias("sha256")).write.parquet(f"{path}/complete/part={part}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """job_id, body of the results whose marker fits them, each once however often it was written."""
    markers = spark.read.parquet(f"{path}/complete").select("job_id", "sha256").distinct()
    return verified(spark.read.parquet(f"{path}/results").select("job_id", "body").distinct(), markers)


def write_request_log(rows: DataFrame, path: str) -> None:
    """One JSON object a line for each request of a run."""
    rows.write.json(path)
