"""Which figures a model is asked about, and which requests are the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.functions.text import is_blank
from leafwise.operators.context import context, context_line, context_text, prompt
from leafwise.operators.project import captions, footnotes, image_text
from leafwise.schema import conform

#: Least share of the page (less if captioned), greatest aspect, least side, area and file size if uncaptioned.
MIN_AREA, MIN_AREA_CAPTIONED, MAX_ASPECT, MIN_SIDE, MIN_PIXELS, MIN_BYTES = 0.01, 0.005, 10.0, 96, 9216, 10240
KEY_VERSION = "2"


def _is(c: Column) -> Column:
    """Unknown measures pass."""
    return F.coalesce(c, F.lit(False))


def skip_reason(*, area_ratio: Column, box_aspect: Column, width: Column, height: Column, size: Column, captioned: Column) -> Column:
    """Why a figure is left out, or NULL; the first rule that fails."""
    least = F.when(captioned, MIN_AREA_CAPTIONED).otherwise(MIN_AREA)
    aspect = F.greatest(width, height) / F.when(F.least(width, height) > 0, F.least(width, height))
    bare = ~captioned
    return (
        F.when(_is(area_ratio < least), "area")
        .when(_is(box_aspect > MAX_ASPECT), "box_aspect")
        .when(_is(aspect > MAX_ASPECT), "aspect")
        .when(bare & _is(F.least(width, height) < MIN_SIDE), "side")
        .when(bare & _is(width * height < MIN_PIXELS), "pixels")
        .when(bare & _is(size < MIN_BYTES), "bytes")
    )


def request_key(digest: Column, context: Column) -> Column:
    """Equal for equal pixels in equal context."""
    return F.sha2(F.concat(F.lit(KEY_VERSION), F.char(F.lit(0)), digest, F.char(F.lit(0)), context), 256)


def first_seen_numbers(rows: DataFrame, *, group: str, order: str, key: str, slices: int | None = None) -> DataFrame:
    """`rows` with image_seq: keys numbered from 1 by first use in their group; a NULL key is its own. `order` is a number.

    Groups of a document's size are numbered in one window. With `slices` a group
    of any size is numbered in that many parts: first uses are counted by their
    slice of the group's order, and a key's number is its place in its slice after
    the keys of all slices before; `rows` are then read several times.
    """
    own = F.coalesce(F.col(key), F.concat(F.lit("row:"), F.col(order)))
    if slices is None:
        first = rows.withColumn("_first", F.min(order).over(W.partitionBy(group, own)))
        return first.withColumn("image_seq", F.dense_rank().over(W.partitionBy(group).orderBy("_first"))).drop("_first")
    keyed = rows.withColumn("_own", own)
    firsts = keyed.groupBy(group, "_own").agg(F.min(order).alias("_first"))
    ends = firsts.groupBy(group).agg(F.min("_first").alias("_low"), F.max("_first").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / slices + 1
    sliced = firsts.join(ends, firsts[group].eqNullSafe(ends[group])).select(firsts["*"], F.floor((F.col("_first") - F.col("_low")) / width).alias("_slice"))
    sizes = sliced.groupBy(F.col(group).alias("_g"), F.col("_slice").alias("_s")).agg(F.count_distinct("_first").alias("_n"))
    before = sizes.withColumn("_n", F.coalesce(F.sum("_n").over(W.partitionBy("_g").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = sliced.withColumn("_r", F.dense_rank().over(W.partitionBy(group, "_slice").orderBy("_first")))
    numbers = ranked.join(before, ranked[group].eqNullSafe(before["_g"]) & (ranked["_slice"] == before["_s"])).select(F.col(group).alias("_g"), F.col("_own").alias("_k"), (F.col("_n") + F.col("_r")).cast("int").alias("image_seq"))
    return keyed.join(numbers, keyed[group].eqNullSafe(numbers["_g"]) & (keyed["_own"] == numbers["_k"])).drop("_own", "_g", "_k")


def measures(blocks: DataFrame) -> DataFrame:
    """Blocks with area_ratio and box_aspect from bbox and page_size; NULL where they can't be known. A box of a normalised page (bbox_normalized) has no aspect."""
    b = blocks if "bbox_normalized" in blocks.columns else blocks.withColumn("bbox_normalized", F.lit(False))
    side = lambda i: F.greatest(F.get("bbox", i + 2) - F.get("bbox", i), F.lit(0.0))
    page = F.get("page_size", 0) * F.get("page_size", 1)
    sized = (F.size("bbox") == 4) & (F.size("page_size") == 2) & (F.get("page_size", 0) > 0) & (F.get("page_size", 1) > 0)
    wide = (F.size("bbox") == 4) & (side(0) > 0) & (side(1) > 0) & ~F.coalesce("bbox_normalized", F.lit(False))
    return b.withColumns({"area_ratio": F.when(sized, side(0) * side(1) / page), "box_aspect": F.when(wide, F.greatest(side(0), side(1)) / F.least(side(0), side(1)))})


def with_file(blocks: DataFrame) -> Column:
    """All-image selection: every figure that names a file."""
    return (F.col("type") == "image") & ~is_blank("img_path")


def image_jobs(blocks: DataFrame, files: DataFrame, *, window: int = 2, positions: bool = False, every: bool = False, strict: bool = False) -> DataFrame:
    """The figures that a model is asked about: doc_id, block_seq, image_seq, page_number, img_path, prompt, base_text, key.

    `files`: doc_id, img_path, sha256, width, height, size of the image files (a
    file that is missing raises). Figures are left out by skip_reason(), none with
    `every`; equal pixels in an equal context (without positions, unless
    `positions`) are one request, numbered by first use in the document.

    `strict` is for reading off what a figure says: captions and notes are neither
    in the prompt nor in the context nor in base_text, and positions count.
    """
    positions = positions or strict
    said = context_text(measures(conform(blocks)), notes=not strict)
    line = lambda kept: F.when(F.col("context").isNotNull(), context_line(F.col("context"), F.coalesce("page_idx", F.lit(-1)), F.col("context_title"), positions=kept))
    said = said.withColumns({"_line": line(True)} if positions else {"_line": line(True), "_bare": line(False)})
    page = F.coalesce("page_idx", F.lit(-1))
    near = context(said, group="doc_id", order="block_seq", line="_line", at=with_file(said), window=window, also={} if positions else {"_bare": ("_bare_before", "_bare_after")})
    met = near.join(files.select("doc_id", "img_path", F.col("sha256").alias("_sha"), F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("size").alias("_size")), ["doc_id", "img_path"], "left")
    there = F.when(F.col("_size").isNull(), F.raise_error(F.concat(F.lit("Missing image asset: "), "img_path")).cast("boolean")).otherwise(True)
    caption, note = (F.array_join(captions(generated=False), "\n"), F.array_join(footnotes(), "\n"))
    reason = skip_reason(area_ratio=F.col("area_ratio"), box_aspect=F.col("box_aspect"), width=F.col("_w"), height=F.col("_h"), size=F.col("_size"), captioned=(caption != "") | (note != ""))
    asked = met.filter(there) if every else met.filter(there).filter(reason.isNull())
    if strict:
        caption = note = F.lit("")
    full = prompt(caption, note, F.col("before"), F.col("after"), page)
    bare = full if positions else prompt(caption, note, F.col("_bare_before"), F.col("_bare_after"))
    out = asked.select(
        "doc_id", "block_seq", (F.coalesce("page_idx", F.lit(0)) + 1).alias("page_number"), "img_path", full.alias("prompt"),
        F.lit("").alias("base_text") if strict else image_text(generated=False).alias("base_text"), F.when(F.col("_sha").isNotNull(), request_key(F.col("_sha"), bare)).alias("key"),
    )
    return first_seen_numbers(out, group="doc_id", order="block_seq", key="key")


def distinct_requests(rows: DataFrame, *, group: str) -> DataFrame:
    """One row for each (group, image_seq): what is really asked."""
    return rows.dropDuplicates([group, "image_seq"])


def pending(requests: DataFrame, results: DataFrame, keys: list[str], *, wave: int | None = None) -> DataFrame:
    """Requests without a result; the first `wave` of each first key if given."""
    left = requests.join(results.select(*keys).distinct(), keys, "left_anti")
    if wave is None:
        return left
    return left.withColumn("_n", F.row_number().over(W.partitionBy(keys[0]).orderBy(*keys[1:]))).filter(F.col("_n") <= wave).drop("_n")
