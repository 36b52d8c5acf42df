"""The block relation: one row per content block of a document, in `block_seq` order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: NULL arrays mean an absent field, empty ones a present empty field.
BLOCK_FIELDS = {
    "type": "string", "text": "string", "text_level": "int", "is_title": "boolean", "page_idx": "int",
    "list_items": "array<string>", "table_caption": "array<string>", "table_body": "string", "table_footnote": "array<string>",
    "img_path": "string", "img_caption": "array<string>", "img_footnote": "array<string>",
    "image_caption": "array<string>", "image_footnote": "array<string>", "chart_caption": "array<string>", "chart_footnote": "array<string>",
    "content": "string", "code_caption": "array<string>", "code_body": "string", "code_footnote": "array<string>",
    "bbox": "array<double>", "page_size": "array<double>", "image_seq": "int",
    # what the field held before surrogates were cleaned away at ingest; NULL: as the text says
    "had_text": "boolean", "had_table": "boolean",
}


def conform(blocks: DataFrame) -> DataFrame:
    """`blocks` (doc_id, block_seq and any block fields) with every block field, absent ones NULL; other columns stay."""
    return blocks.withColumns({c: F.lit(None).cast(t) for c, t in BLOCK_FIELDS.items() if c not in blocks.columns})
