"""File scans that remember where they are: every file once, over any number of runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from leafwise.functions.text import OFFICE_FORMATS, PAGE_FORMATS, extension

FILE = "path string, modificationTime timestamp, length long, content binary"


def files_as_they_come(spark: SparkSession, path: str, *, formats: Iterable[str] = (*PAGE_FORMATS, *OFFICE_FORMATS), files_per_batch: int = 1000, recursive: bool = False) -> DataFrame:
    """A stream of path, modificationTime, length, content, sha256 of the supported files under `path`: those changed first come first, at most `files_per_batch` in a batch."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.filter(extension("path").isin([f".{f}" for f in formats])).withColumn("sha256", F.sha2("content", 256))


def scan_on(stream: DataFrame, out: str, *, checkpoint: str) -> StreamingQuery:
    """Start to add what is new in `stream` to the table `out`, with the number of the batch that found it; ends with what there is now.

    The checkpoint is the cursor: a later call goes on behind the last batch that
    was written whole. A batch has a folder of its own, which it replaces when it
    is done again after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
