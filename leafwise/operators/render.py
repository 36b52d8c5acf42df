"""Chunks and blocks to one text per document. The unit is a document; its pieces are ordered by block_seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.functions.text import lines, strip
from leafwise.operators.project import _arr, filled
from leafwise.schema import conform


def ordered_text(rows: DataFrame, piece: str, by: str = "") -> Column:
    """Aggregate: the pieces of a group in block_seq order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_seq", piece))), lambda x: x[piece]), by)


def plain_text(chunks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, txt, n_chunks: non-blank chunks, stripped; a title is followed by an empty line. `docs` names documents that may have no chunk."""
    given = chunks.withColumn("piece", strip("text"))
    end = F.when(F.col("type") == "title", "\n\n").otherwise("\n")
    pieces = given.withColumn("piece", F.when(F.col("piece") != "", F.concat("piece", end)))
    txt = pieces.groupBy("doc_id").agg(F.regexp_replace(ordered_text(pieces, "piece"), r"\n+\z", "").alias("txt"), F.count("*").alias("n_chunks"))
    if docs is None:
        return txt.filter("txt <> ''")
    return docs.select("doc_id").distinct().join(txt, "doc_id", "left").select("doc_id", F.coalesce("txt", F.lit("")).alias("txt"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, markdown: headings by level, lists as items, tables and figures with captions and notes."""
    b = conform(blocks)
    own, kind = strip(F.coalesce("text", F.lit(""))), F.col("type")
    level = F.greatest(F.coalesce("text_level", F.when(F.col("is_title"), 0)), F.lit(0))
    level = F.when(F.col("text_level").isNotNull() | F.coalesce("is_title", F.lit(False)), level)
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.greatest(level + 1, F.lit(1)), F.lit(6))), F.lit(" "), own)
    items = F.transform(filled(_arr("list_items")), strip)
    listed = F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(own)
    paragraphs = lambda *cs: F.array_join(F.transform(filled(F.concat(*cs)), strip), "\n\n")
    piece = (
        F.when(kind.isin("text", "equation"), F.when(own == "", "").when(level.isNotNull(), heading).otherwise(own))
        .when(kind == "list", F.when(level.isNotNull() & (own != "") & (listed != ""), F.concat(heading, F.lit("\n\n"), listed)).otherwise(listed))
        .when(kind == "table", paragraphs(_arr("table_caption"), F.array(F.coalesce("table_body", F.lit(""))), _arr("table_footnote")))
        .when(kind == "image", paragraphs(_arr("img_caption"), _arr("img_footnote")))
        .otherwise(own)
    )
    pieces = b.withColumn("piece", strip(piece)).filter(F.col("piece") != "")
    return pieces.groupBy("doc_id").agg(ordered_text(pieces, "piece", "\n\n").alias("markdown"))


def write_markdown(texts: DataFrame, path: str) -> None:
    """One file of text for each document (doc_id, markdown), under a folder of its name: `doc_id=<id>/part-*.txt`, the text as it is, without a line end behind."""
    one = texts.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("markdown", F.lit("")).alias("value"))
    one.repartition("doc_id").sortWithinPartitions("doc_id").write.option("lineSep", "\x01").partitionBy("doc_id").text(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, markdown of what write_markdown wrote."""
    got = spark.read.schema("value string, doc_id string").text(path, wholetext=True)
    return got.select("doc_id", F.regexp_replace("value", "\x01\\z", "").alias("markdown"))


def responses(chunks: DataFrame, txt: DataFrame | None = None, *, nulls: bool = False) -> DataFrame:
    """doc_id, body: the JSON of each document's chunks, and its text if given."""
    fields = F.struct("text", "page_number", "type")
    result = chunks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_seq", fields.alias("c")))), lambda x: x["c"]).alias("result"))
    if txt is not None:
        result = txt.select("doc_id", "txt").join(result, "doc_id", "left").withColumn("result", F.coalesce("result", F.expr("array()").cast(result.schema["result"].dataType)))
    else:
        result = result.withColumn("txt", F.lit(None).cast("string"))
    return result.select("doc_id", F.to_json(F.struct("result", "txt"), {"ignoreNullFields": str(not nulls).lower()}).alias("body"))


def content_list(blocks: DataFrame) -> DataFrame:
    """doc_id, body: each document's blocks in order as one JSON array; absent fields are left out."""
    fields = [c for c in blocks.columns if c not in ("doc_id", "block_seq")]
    item = F.struct("block_seq", F.to_json(F.struct(*fields)).alias("j"))
    return blocks.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"]), ", "), F.lit("]")).alias("body"))


def tidy_markdown(text: Column) -> Column:
    """Markdown with an empty line around headings and before table captions, one between paragraphs at most, and no white space at line ends."""
    spaced = F.regexp_replace(text, r"([^\n])\n(:[^\n]*\n)", "$1\n\n$2")
    spaced = F.regexp_replace(spaced, r"(^|\n)(:[^\n]*?)\n(\|)", "$1$2\n\n$3")
    heading = lambda x: F.regexp_replace(x, r"(?U)^(#{1,6})\s+(.+)$", "$1 $2")
    bare = F.transform(lines(spaced), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))
    framed = F.transform(bare, lambda x: F.when(x.rlike(r"(?U)^#{1,6}\s+.+$"), F.concat(F.lit("\n"), heading(x), F.lit("\n"))).otherwise(x))
    joined = F.regexp_replace(F.array_join(framed, "\n"), r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(joined, r"^\n+|\n+\z", ""), F.lit("\n"))


#: Paragraphs that are page breaks: TeX commands, a form feed, an HTML comment or empty block, a fenced block.
PAGE_BREAKS = (
    r"^\s*\\(?:newpage|pagebreak|clearpage)\s*$", r"^[ \t\n]*\f[ \t\n]*$", r"(?i)<!--\s*pagebreak\s*-->",
    r"(?i)<div[^>]*class\s*=\s*\"[^\"]*pagebreak[^\"]*\"[^>]*>\s*</div>", r"^\s*:::+\s*(?:pagebreak|\{[^}]*\.pagebreak[^}]*\})",
)


def is_page_break(text: Column) -> Column:
    return F.coalesce(F.exists(F.array(*[text.rlike(p) for p in PAGE_BREAKS]), lambda x: x), F.lit(False))


#: How figures and tables are named in references.
REFERENCE = {"fig": "图", "tbl": "表"}


def label_numbers(labels: DataFrame) -> DataFrame:
    """doc_id, label, number: labels such as `fig:pump` numbered from 1 by first use within document and kind. `labels`: doc_id, position, label."""
    kind = F.regexp_extract("label", "^([A-Za-z]+):", 1)
    firsts = labels.filter(kind != "").groupBy("doc_id", "label").agg(F.min("position").alias("_first"))
    ranked = firsts.withColumn("number", F.row_number().over(W.partitionBy("doc_id", kind).orderBy("_first", "label")))
    return ranked.select("doc_id", "label", "number")


def with_references(texts: DataFrame, numbers: DataFrame) -> DataFrame:
    """`texts` (doc_id, text) where `[@fig:x]` and `[@tbl:x]` of a known label read as its name and number; others stay as they are."""
    named = F.create_map(*[F.lit(x) for pair in REFERENCE.items() for x in pair])
    known = numbers.withColumn("_n", F.try_element_at(named, F.regexp_extract("label", "^([A-Za-z]+):", 1))).filter("_n IS NOT NULL")
    maps = known.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.concat("_n", "number").alias("v")))).alias("_m"))
    marks = F.split(F.regexp_replace("text", r"\[@([\w:.-]+)\]", "\x01@$1\x01"), "\x01")
    shown = F.transform(marks, lambda x: F.when(x.startswith("@"), F.coalesce(F.try_element_at("_m", F.substring(x, F.lit(2), F.length(x))), F.concat(F.lit("["), x, F.lit("]")))).otherwise(x))
    met = texts.join(maps, "doc_id", "left")
    return met.withColumn("text", F.when(F.col("text").contains("[@"), F.array_join(shown, "")).otherwise(F.col("text"))).drop("_m")
