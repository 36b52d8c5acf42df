"""Text around a figure: the nearest non-empty lines before and after it, and the prompt made of them.

Each non-empty line carries the few lines up to it and from it on; a figure takes
those of the nearest line on either side. All of it are windows over one
partitioning by document: no block is joined with another, and no array is longer
than the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.functions.text import is_blank, strip
from leafwise.operators.project import image_text, list_text, table_text
from leafwise.schema import conform


def context_line(text: Column, page: Column, title: Column, *, positions: bool = True) -> Column:
    """`[Page N] [ChunkType=Title|Body] text`, without the page if positions are left out."""
    where = F.when(F.lit(positions) & (page >= 0), F.concat(F.lit("[Page "), page + 1, F.lit("]")))
    return F.concat_ws(" ", where, F.when(title, "[ChunkType=Title]").otherwise("[ChunkType=Body]"), text)


def context_text(blocks: DataFrame, *, notes: bool = True) -> DataFrame:
    """Blocks with `context` (what a block says to its neighbours) and `context_title`; other blocks than text, lists, tables and figures say nothing.

    A figure says its printed captions and notes, not the generated ones; without `notes` it says nothing.
    """
    b = conform(blocks)
    kind, own = F.col("type"), F.coalesce("text", F.lit(""))
    said = F.when(kind.isin("text", "equation"), own).when(kind == "list", list_text()).when(kind == "table", table_text()).when((kind == "image") & F.lit(notes), image_text(generated=False))
    return b.withColumns({"context": F.when(~is_blank(said), strip(said)), "context_title": kind.isin("text", "equation", "list") & F.col("text_level").isNotNull()})


def context(rows: DataFrame, *, group: str, order: str, line: str, at: Column, window: int = 2, names: tuple[str, str] = ("before", "after"), also: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The rows where `at` holds, with `before` and `after`: up to `window` non-empty lines of `line` on either side.

    `also`: further forms of the same lines (blank where `line` is), with the names of what is before and after in them.
    """
    forms = {line: names} | (also or {})
    flagged = rows.withColumns({"_full": ~is_blank(line), "_at": at, "_forms": F.struct(*forms)})
    lines = W.partitionBy(group, "_full")
    up_to = F.collect_list("_forms").over(lines.orderBy(order).rowsBetween(1 - window, W.currentRow))
    onward = F.collect_list("_forms").over(lines.orderBy(order).rowsBetween(W.currentRow, window - 1))
    held = flagged.withColumns({"_to": F.when(F.col("_full"), up_to), "_on": F.when(F.col("_full"), onward)})
    # The nearest line before is the last one so far; the nearest after it is the last one so far from the other end.
    rest = W.partitionBy(group).rowsBetween(W.unboundedPreceding, -1)
    near = held.withColumns({"_to": F.last("_to", ignorenulls=True).over(rest.orderBy(order)), "_on": F.last("_on", ignorenulls=True).over(rest.orderBy(F.desc(order)))})
    text = lambda c, form: F.coalesce(F.array_join(F.transform(c, lambda x: x[form]), "\n"), F.lit(""))
    said = {name: text(F.col(side), form) for form, pair in forms.items() for name, side in zip(pair, ("_to", "_on"), strict=True)}
    return near.filter("_at").withColumns(said).drop("_full", "_at", "_forms", "_to", "_on")


def prompt(caption: Column, footnote: Column, before: Column, after: Column, page: Column | None = None) -> Column:
    """Labelled lines for what is not blank; with `page` (0-based) the caption's place is told."""
    suffix = F.lit("") if page is None else F.when(page >= 0, F.concat(F.lit(" (Page "), page + 1, F.lit(")"))).otherwise("")
    part = lambda name, c, end=F.lit(""): F.when(~is_blank(c), F.concat(F.lit(name), end, F.lit(": "), c))
    return F.concat_ws("\n", part("Image caption", caption, suffix), part("Image footnote", footnote, suffix), part("Context before", before), part("Context after", after))
