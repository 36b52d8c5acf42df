"""Blocks to chunks. One projection without a shuffle; the modes differ in what they emit and keep.

plain        text that is empty after cleaning is dropped; images give their captions and never a type
images       an image with a path gives its stored text, else its captions; empty text is kept
two_stage    an image with a path gives captions and the model's text for its image_seq
parse        as images, but no chunk is typed `image`
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.functions.text import is_blank, join_parts, strip
from leafwise.schema import conform

MODES = ("plain", "images", "two_stage", "parse")
_NONE = "array<string>"


def _arr(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(_NONE))


def filled(c: Column) -> Column:
    return F.filter(c, lambda x: ~is_blank(x))


def captions(*, generated: bool) -> Column:
    """An image's captions. Without the generated ones: the first present printed field, else all but a last one that repeats `content`."""
    own = F.when(F.size(_arr("img_caption")) > 0, _arr("img_caption")).otherwise(_arr("image_caption"))
    if generated:
        return filled(own)
    drop = (F.size(own) > 0) & (F.element_at(own, -1) == F.col("content"))
    bare = F.when(F.coalesce(drop, F.lit(False)), F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))).otherwise(own)
    return filled(F.coalesce(F.col("image_caption"), F.col("chart_caption"), bare))


def footnotes() -> Column:
    return filled(F.when(F.size(_arr("img_footnote")) > 0, _arr("img_footnote")).otherwise(_arr("image_footnote")))


def image_text(*, generated: bool = True) -> Column:
    return F.array_join(F.concat(captions(generated=generated), footnotes()), "\n")


def table_text() -> Column:
    return join_parts(F.concat(_arr("table_caption"), F.array(F.coalesce("table_body", F.lit(""))), _arr("table_footnote")))


def list_text() -> Column:
    return F.when(F.size(_arr("list_items")) > 0, F.array_join(_arr("list_items"), "\n")).otherwise(F.coalesce("text", F.lit("")))


def project(blocks: DataFrame, *, mode: str = "plain", chunk_type: bool = False) -> DataFrame:
    """doc_id, block_seq, text, page_number, type of the chunks that the blocks give.

    images and parse read `stored_text`, two_stage `vision_text` (a block with an
    image_seq must have one); see merge_vision().
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    b = conform(blocks)
    for c in ("stored_text", "vision_text"):
        if c not in b.columns:
            b = b.withColumn(c, F.lit(None).cast("string"))
    plain, raw, kind = mode == "plain", F.coalesce("text", F.lit("")), F.col("type")
    had = F.coalesce("had_text", ~is_blank(raw))
    had_table = F.coalesce("had_table", (F.size(_arr("table_caption")) > 0) | (F.coalesce("table_body", F.lit("")) != "") | (F.size(_arr("table_footnote")) > 0))
    kept = lambda c: F.when(c != "", c) if plain else c
    legacy = F.array_join(F.concat(_arr("img_caption"), _arr("img_footnote")), "\n")
    with_path = ~is_blank("img_path")
    if plain:
        image = F.when(legacy != "", legacy)
    elif mode == "two_stage":
        missing = F.col("image_seq").isNotNull() & is_blank("vision_text")
        error = F.raise_error(F.concat(F.lit("Missing or empty vision result for seq="), F.col("image_seq")))
        parts = F.array(F.when(F.col("image_seq").isNull(), image_text()).otherwise(image_text(generated=False)), F.coalesce("vision_text", F.lit("")))
        image = F.when(missing, error.cast("string")).when(with_path, join_parts(parts)).when(legacy != "", legacy)
        image = F.when(image != "", image)
    else:
        image = F.when(with_path, F.when(~is_blank("stored_text"), strip("stored_text"))).otherwise(F.when(image_text() != "", image_text()))
    page_like = F.when(~is_blank(raw), raw)
    listed = F.when(F.exists(_arr("list_items"), lambda x: ~is_blank(x)) | ~is_blank(raw), list_text())
    text = (
        F.when(kind.isin("text", "equation"), F.when(had, kept(raw)))
        .when(kind.isin("header", "footer"), page_like if chunk_type else F.lit(None).cast("string"))
        .when(kind == "list", kept(listed) if plain else F.when(~is_blank(listed), listed))
        .when(kind == "table", F.when(had_table, kept(table_text())))
        .when(kind == "image", image)
    )
    named = (
        F.when((kind == "text") & F.col("text_level").isNotNull(), "title")
        .when(kind.isin("header", "footer"), kind)
        .when((kind == "image") & F.lit(mode in ("images", "two_stage")), "image")
        if chunk_type
        else F.lit(None).cast("string")
    )
    out = b.select("doc_id", "block_seq", text.alias("text"), (F.coalesce("page_idx", F.lit(0)) + 1).alias("page_number"), named.alias("type"))
    return out.filter("text IS NOT NULL")


def merge_vision(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """Blocks with the model's text for their image_seq; `results`: doc_id, image_seq, vision_text."""
    return conform(blocks).join(results.select("doc_id", "image_seq", "vision_text"), ["doc_id", "image_seq"], "left")


def normalize(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Parser blocks in the types that projection knows; boxes (0 to 1000) in points where the page's size is known.

    `pages`: doc_id, page_idx, width_pt, height_pt.
    """
    b = conform(blocks)
    kind, figure = F.col("type"), F.col("type").isin("image", "chart")
    name = F.when(kind == "chart", "image").when(kind.isin("code", "page_footnote"), "text").when(kind == "index", "list").otherwise(kind)
    printed = F.coalesce(F.when(kind == "chart", F.col("chart_caption")), F.col("image_caption"), _arr("img_caption"))
    body = F.when(~is_blank("content"), F.array("content")).otherwise(F.array().cast(_NONE))
    notes = F.coalesce(F.when(kind == "chart", F.col("chart_footnote")), F.col("image_footnote"), _arr("img_footnote"))
    code = join_parts(F.concat(_arr("code_caption"), F.array(F.coalesce("code_body", F.lit(""))), _arr("code_footnote")))
    b = b.withColumns({
        "img_caption": F.when(figure, F.concat(printed, body)).otherwise(F.col("img_caption")),
        "img_footnote": F.when(figure, notes).otherwise(F.col("img_footnote")),
        "text": F.when(kind == "code", code).otherwise(F.col("text")),
        "type": name,
    })
    if pages is None:
        return b
    b = b.join(pages.select("doc_id", "page_idx", "width_pt", "height_pt"), ["doc_id", "page_idx"], "left")
    scale = F.array("width_pt", "height_pt", "width_pt", "height_pt")
    known = F.col("width_pt").isNotNull() & F.col("height_pt").isNotNull() & F.col("bbox").isNotNull()
    return b.withColumns({
        "bbox": F.when(known, F.zip_with("bbox", scale, lambda x, s: x * s / 1000)).otherwise(F.col("bbox")),
        "page_size": F.when(known, F.array("width_pt", "height_pt")).otherwise(F.col("page_size")),
    }).drop("width_pt", "height_pt")


def _check_range(first: int | None, last: int | None) -> None:
    for p in (first, last):
        if p is not None and (isinstance(p, bool) or p < 0):
            raise ValueError("page numbers are not negative")
    if last is not None and last < (first or 0):
        raise ValueError("the last page is before the first")


def range_text(first: int = 0, last: int | None = None) -> str:
    """The 0-based pages first..last as a parser's option: `a-b` from 1, `a-r1` up to the end, `all`."""
    _check_range(first, last)
    if last is not None:
        return f"{first + 1}-{last + 1}"
    return f"{first + 1}-r1" if first else "all"


def page_range(blocks: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Blocks on the 0-based pages first..last."""
    _check_range(first, last)
    page = F.coalesce("page_idx", F.lit(0))
    return blocks.filter((page >= (first or 0)) & (page <= (last if last is not None else 2**31 - 1)))


def pages_of(blocks: DataFrame, pages: str) -> DataFrame:
    """Blocks on the pages that a range_text() names; `rN` counts from a document's last page."""
    if pages == "all":
        return blocks
    first, _, last = pages.partition("-")
    if not last.startswith("r"):
        return page_range(blocks, int(first) - 1, int(last) - 1)
    page = F.coalesce("page_idx", F.lit(0))
    ends = blocks.groupBy("doc_id").agg((F.max(page) + 1 - int(last[1:])).alias("_end"))
    return page_range(blocks, int(first) - 1).join(ends, "doc_id").filter(page <= F.col("_end")).drop("_end")


def project_articles(blocks: DataFrame) -> DataFrame:
    """doc_id, block_seq, text, page_number, type of scientific articles: equations may be titles as well, and there are no headers or footers.

    `blocks` without the sections that sections.without_sections() leaves out.
    """
    b = conform(blocks)
    own, kind = F.coalesce("text", F.lit("")), F.col("type")
    figure = F.concat(_arr("img_caption"), _arr("img_footnote"))
    table = F.concat(_arr("table_caption"), _arr("table_footnote"))
    listed = F.exists(_arr("list_items"), lambda x: ~is_blank(x)) | ~is_blank(own)
    text = (
        F.when(kind.isin("text", "equation") & ~is_blank(own), own)
        .when((kind == "list") & listed, list_text())
        .when((kind == "table") & ((F.size(table) > 0) | (F.coalesce("table_body", F.lit("")) != "")), table_text())
        .when((kind == "image") & (F.size(figure) > 0), F.array_join(figure, "\n"))
    )
    title = F.when(kind.isin("text", "equation") & F.col("text_level").isNotNull(), "title")
    return b.select("doc_id", "block_seq", text.alias("text"), (F.coalesce("page_idx", F.lit(0)) + 1).alias("page_number"), title.alias("type")).filter("text IS NOT NULL")


def checked_assets(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """`blocks`; reading them raises if a block names an image file that `files` (doc_id, img_path) doesn't hold."""
    held = files.select("doc_id", "img_path").distinct().withColumn("_held", F.lit(True))
    lost = ~is_blank("img_path") & F.col("_held").isNull()
    met = blocks.join(held, ["doc_id", "img_path"], "left")
    return met.filter(F.when(lost, F.raise_error(F.concat(F.lit("Missing image asset: "), "img_path")).cast("boolean")).otherwise(True)).select(*blocks.columns)


def visible(chunks: DataFrame, *, chunk_type: bool) -> DataFrame:
    """What a response shows: no page numbers; headers, footers and types only on request."""
    out = chunks.filter("type IS NULL OR type <> 'page_number'")
    if not chunk_type:
        out = out.filter("type IS NULL OR type NOT IN ('header', 'footer')").withColumn("type", F.lit(None).cast("string"))
    return out
