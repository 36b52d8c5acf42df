"""Section filter: sections under certain headings are left out, up to the next heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.functions.text import is_dropped_heading


def without_sections(blocks: DataFrame, dropped: Column | None = None) -> DataFrame:
    """Blocks whose latest heading (their own included) is not `dropped`: by default the usual back matter."""
    flag = is_dropped_heading("text") if dropped is None else dropped
    heading = F.when(F.col("text_level").isNotNull(), flag)
    before = W.partitionBy("doc_id").orderBy("block_seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return blocks.withColumn("_in", F.coalesce(F.last(heading, ignorenulls=True).over(before), F.lit(False))).filter("NOT _in").drop("_in")
