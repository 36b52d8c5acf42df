"""Web pages to blocks: titles, headings, paragraphs, list entries and footers, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwise.functions.text import named, strip

#: A mark is set before each tag that begins or ends a block; scripts and styles are no text.
OPENING = r"(?is)<(/?(?:title|h1|p|li|footer|nav|ul|article|head|body|html|br)\b)"
BLOCK = r"(?is)^<(title|h1|p|li|footer)\b[^>]*>(.*)$"
PAGE_BLOCKS = 10


def page_blocks(pages: DataFrame, *, per_page: int = PAGE_BLOCKS) -> DataFrame:
    """doc_id, block_seq, type, text, text_level, list_items, page_idx of `pages` (page_id, html). Per-row work, no shuffle."""
    bare = F.coalesce("html", F.lit(""))
    for tag in ("script", "style"):
        bare = F.regexp_replace(bare, f"(?is)<{tag}\\b.*?</{tag}>", "")
    parts = F.split(F.regexp_replace(bare, OPENING, "\x01<$1"), "\x01")
    # A part is taken apart once, inside the array; only blocks leave it.
    tag = lambda x: F.lower(F.regexp_extract(x, BLOCK, 1))
    own = lambda x: F.regexp_extract(x, BLOCK, 2)
    shaped = F.transform(parts, lambda x, i: F.struct(i.alias("seq"), tag(x).alias("tag"), own(x).alias("raw")))
    part = pages.select(F.col("page_id").alias("doc_id"), F.explode(F.filter(shaped, lambda p: p["tag"] != "")).alias("p")).select("doc_id", F.col("p.seq").alias("block_seq"), "p.tag", "p.raw")
    out = part.select("doc_id", "block_seq", "tag", strip(named(F.regexp_replace("raw", r"<[^>]*>", ""))).alias("own"))
    kind = F.when(F.col("tag") == "title", "header").when(F.col("tag") == "footer", "footer").when(F.col("tag") == "li", "list").otherwise("text")
    return out.select(
        "doc_id", "block_seq", kind.alias("type"),
        F.when(F.col("tag") != "li", F.col("own")).alias("text"),
        F.when(F.col("tag") == "h1", 1).alias("text_level"),
        F.when(F.col("tag") == "li", F.array("own")).alias("list_items"),
        F.floor(F.col("block_seq") / per_page).cast("int").alias("page_idx"),
    )
