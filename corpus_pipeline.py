"""A training corpus in five stages; each works on what the one before has kept.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir) and gives
a DataFrame, which is written as Parquet and read again for the next stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafwise.llm.bpe import bpe_encode
from leafwise.llm.common import few_rows, kept_from, marked, remove, scratch, shared_dir, table, text_hash, unused
from leafwise.llm.decontaminate import contaminated
from leafwise.llm.quality import keep_good
from leafwise.llm.secrets import redact
from leafwise.llm.shingles import near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good ones stay.

    Rows are judged one by one by their text: null texts as empty ones, null and
    repeated doc_ids like others; without labels all stay; no rows give no rows.
    """
    few_rows(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id. Five-word shingles, Jaccard similarity of 0.8 or more.

    A null doc_id comes last. Rows with the same doc_id and text are copies of each
    other; rows that share a doc_id and differ in text are documents of their own.
    Empty and null texts are copies of each other. No rows give no rows.
    """
    few_rows(spark)
    found = kept_from(spark, lambda: near_copies(docs, words=5))
    kept = marked(docs, found.filter("NOT kept").select("doc_id", "t"), "left_anti")
    repeated = found.filter("kept AND n_rows > 1").select("doc_id", "t")
    if repeated.isEmpty():
        return kept
    mark = unused(kept, "t")
    one = marked(kept, repeated, "left_semi").withColumn(mark, text_hash(kept["text"])).dropDuplicates(["doc_id", mark]).drop(mark)
    return marked(kept, repeated, "left_anti").unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go.

    Decided for each text, so a copy with a null doc_id goes too, and of rows that
    share a doc_id only those whose text holds the copy. Empty texts stay; without
    items all stay; no rows give no rows.
    """
    few_rows(spark)
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "t").distinct()
    return marked(docs, found, "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts, in every row by its own text, whatever its doc_id; null texts stay null. No rows give no rows."""
    few_rows(spark)
    return redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, a row for each row, with the hashes of ids and decoded text; null texts count as empty. No rows give no rows."""
    few_rows(spark)
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("encode", encode)]

#: The classifier, the shingle sets and the alignment are beyond SQL; a test holds the second stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; stages are written to the shared folder, and taken away when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
