"""Checkbox repair: marks in recognised text are set right by the words of the page's own text layer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.functions.text import label, labels_match, unescape
from leafwise.sources.shared import kept

#: Fixed values.
MARKS, SELECTED = "☐☑□■", "☑■"
ROW_TOLERANCE = 3.0


def has_mark(*texts: Column) -> Column:
    return F.exists(F.array(*texts), lambda t: F.coalesce(t, F.lit("")).rlike(f"[{MARKS}]"))


def visual_rows(words: DataFrame, *, page: list[str], y: str = "y_min", x: str = "x_min", text: str = "text", tolerance: float = ROW_TOLERANCE, path: str | None = None) -> DataFrame:
    """page columns, row_nr, words: words in rows of a page; a row's words lie within `tolerance` of its first word.

    A row starts where its anchor is left, not where a gap is, so a page's distinct
    heights are folded in order to the heights at which rows start; words then find
    their row by height. For pages of any size name a folder, `path`: heights are
    then folded over range partitions (row_anchors), and no page is gathered.
    Words without a height are in no row then, and in the first one else.
    """
    height = F.col(y).cast("double")
    if path is not None:
        anchors = row_anchors(words, path, page=page, y=y, tolerance=tolerance)
        starts = anchors.select(*page, "anchor").distinct()
        numbers = starts.select(*[F.col(c).alias(f"_{c}") for c in page], F.col("anchor").alias("_a"), (F.row_number().over(W.partitionBy(*page).orderBy("anchor")) - 1).alias("row_nr"))
        same = lambda left, right: [left[c].eqNullSafe(right[f"_{c}"]) for c in page]
        named = anchors.join(numbers, [*same(anchors, numbers), anchors["anchor"] == numbers["_a"]]).select(*[F.col(c).alias(f"_{c}") for c in page], F.col(y).alias("_at"), "row_nr")
        own = words.select(*page, height.alias("_y"), F.col(x).cast("double").alias("_x"), F.col(text).alias("_w"))
        met = own.join(named, [*same(own, named), own["_y"] == named["_at"]])
        return met.groupBy(*page, "row_nr").agg(F.transform(F.array_sort(F.collect_list(F.struct("_x", "_y", "_w"))), lambda e: e["_w"]).alias("words"))
    levels = words.groupBy(*page).agg(F.array_sort(F.collect_set(height)).alias("ys"))
    starts = F.aggregate(
        "ys",
        F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<double>").alias("starts")),
        lambda acc, e: F.when(F.coalesce(F.abs(acc["anchor"] - e) <= tolerance, F.lit(False)), acc).otherwise(F.struct(e.alias("anchor"), F.concat(acc["starts"], F.array(e)).alias("starts"))),
        lambda acc: acc["starts"],
    )
    rows = levels.select(*page, F.posexplode(starts).alias("row_nr", "from_y"))
    # Words and row starts are put in one order of heights; a word belongs to the last start before it.
    marks = rows.select(*page, F.col("from_y").alias("_y"), F.lit(0).alias("_kind"), F.col("row_nr").alias("_start"), F.lit(None).cast("double").alias("_x"), F.lit(None).cast("string").alias("_w"))
    own = words.select(*page, height.alias("_y"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_start"), F.col(x).cast("double").alias("_x"), F.col(text).alias("_w"))
    before = W.partitionBy(*page).orderBy("_y", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = marks.unionByName(own).withColumn("_at", F.last("_start", ignorenulls=True).over(before)).filter("_kind = 1")
    return placed.groupBy(*page, F.col("_at").alias("row_nr")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_x", "_y", "_w"))), lambda e: e["_w"]).alias("words"))


def _past(ys: np.ndarray, tolerance: float) -> np.ndarray:
    """For each of the sorted heights the place of the first one that lies more than `tolerance` behind it."""
    at = np.searchsorted(ys, ys + tolerance, side="right")
    last = len(ys) - 1
    # ys + tolerance is rounded; the rule is the difference.
    while (low := (at <= last) & (ys[np.minimum(at, last)] - ys <= tolerance)).any():
        at = at + low
    while (high := (at > np.arange(len(ys)) + 1) & (ys[at - 1] - ys > tolerance)).any():
        at = at - high
    return at


def _crossing(ys: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """What a run of sorted heights makes of an anchor before it: heights at which a first row may start, and the last anchor that follows from each; equal neighbours are one.

    Starts are followed by doubling steps, so the work does not depend on how many rows there are.
    """
    after = np.append(_past(ys, tolerance), len(ys))
    end = np.arange(len(ys) + 1)
    reach = after.copy()
    while not (reach == len(ys)).all():  # `end`: the last start on the way; `reach`: where it jumps to
        end = np.where(reach < len(ys), end[np.minimum(reach, len(ys))], end)
        reach = after[end]
    entries = np.arange(min(int(after[0]) + 1, len(ys)))  # the heights near the first one, and the next behind them
    exits = ys[end[entries]]
    kept = np.append(exits[1:] != exits[:-1], True)
    return ys[entries][kept], exits[kept]


def row_anchors(heights: DataFrame, path: str, *, page: list[str], y: str, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """page columns, y, anchor of each distinct height: the height at which its row starts. Pages may be of any size.

    Heights are sorted over range partitions and folded in order; what a partition
    needs of those before is one anchor. So each tells first what it would make of
    any anchor before it (a few steps: the heights within `tolerance` of its
    first), the driver follows these from partition to partition, and then each
    folds its own heights. `path` is a folder for the sorted heights.
    """
    spark = heights.sparkSession
    order = [F.col(c).asc_nulls_first() for c in (*page, y)]
    named = heights.select(*page, F.col(y).cast("double").alias(y)).filter(F.col(y).isNotNull()).distinct()
    run = kept(named.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_page": F.to_json(F.struct(*page))}), path)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, np.ndarray]]:
        """Part, page and heights of each run of equal parts and pages."""
        own, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = pa.StructArray.from_arrays([batch.column("_part"), batch.column("_page")], names=["part", "page"]).to_pylist()
            ys = batch.column(y).to_numpy()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = (names[a]["part"], names[a]["page"])
                if key != own and held:
                    yield *own, np.concatenate(held)
                    held = []
                own = key
                held.append(ys[a:b])
        if held:
            yield *own, np.concatenate(held)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, name, ys in pages(batches):
            entries, exits = _crossing(ys, tolerance)
            yield pa.RecordBatch.from_pylist([{"_part": part, "_page": name, "first": float(ys[0]), "entries": entries.tolist(), "exits": exits.tolist()}], told)

    told = pa.schema([("_part", pa.int32()), ("_page", pa.string()), ("first", pa.float64()), ("entries", pa.list_(pa.float64())), ("exits", pa.list_(pa.float64()))])
    dealt = run.select("_part", "_page", y).repartition("_part").sortWithinPartitions("_part", "_page", y)
    # Only pages that cross from one partition to another have an anchor to carry.
    crossing = run.groupBy("_page").agg(F.min("_part").alias("a"), F.max("_part").alias("b")).filter("a < b").select("_page")
    steps = dealt.mapInArrow(tell, "_part int, _page string, first double, entries array<double>, exits array<double>").join(crossing, "_page", "left_semi")
    carried: dict[int, tuple[str, float]] = {}
    before: dict[str, float] = {}
    for r in steps.orderBy("_part", "first").toLocalIterator():
        anchor = before.get(r["_page"])
        if anchor is not None:
            carried[r["_part"]] = (r["_page"], anchor)
        at = 0 if anchor is None else next((i for i, e in enumerate(r["entries"]) if e - anchor > tolerance), -1)
        before = {r["_page"]: anchor if at < 0 else r["exits"][at]}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, name, ys in pages(batches):
            after, anchors = _past(ys, tolerance), np.empty(len(ys))
            at, (known, anchor) = 0, carried.get(part, ("", 0.0))
            if known == name:
                at = int(np.argmax(ys - anchor > tolerance)) if (ys - anchor > tolerance).any() else len(ys)
                anchors[:at] = anchor
            while at < len(ys):
                anchors[at : after[at]] = ys[at]
                at = int(after[at])
            for a in range(0, len(ys), 65_536):
                some = slice(a, a + 65_536)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ys[some])), pa.array(ys[some]), pa.array(anchors[some])], names=["_page", y, "anchor"])

    shape = run.select(F.struct(*page)).schema[0].dataType.simpleString()
    out = dealt.mapInArrow(fold, f"_page string, {y} double, anchor double")
    return out.select(F.from_json("_page", shape).alias("_p"), y, "anchor").select("_p.*", y, "anchor")


def source_entries(rows: DataFrame, *, page: list[str]) -> DataFrame:
    """page columns, row_nr, entry_nr, label, selected: the marked options of visual rows; a lone mark takes the next word."""
    word = rows.select(*page, "row_nr", F.posexplode("words").alias("at", "w"), "words")
    mark, rest = F.substring("w", 1, 1), F.trim(F.expr("substring(w, 2)"))
    after = F.coalesce(F.get("words", F.col("at") + 1), F.lit(""))
    own = F.when(rest != "", rest).when(~after.rlike(f"^[{MARKS}]"), F.trim(after)).otherwise("")
    out = word.filter(F.col("w").rlike(f"^[{MARKS}]")).select(*page, "row_nr", F.col("at").alias("entry_nr"), own.alias("label"), mark.rlike(f"[{SELECTED}]").alias("selected"))
    return out.filter(label("label") != "")


def text_entries(value: Column) -> Column:
    """Array of struct(label, selected): the marked options of a text, in order; a short first word is the label."""
    found = F.regexp_extract_all(value, F.lit(f"([{MARKS}][^{MARKS}]*)"), 1)
    body = lambda e: F.trim(F.regexp_replace(F.substring(e, 2, 1 << 30), r"(?U)\s+", " "))
    short = lambda b: F.when((F.size(F.split(b, " ")) > 1) & (F.length(F.split(b, " ")[0]) <= 4), F.split(b, " ")[0]).otherwise(b)
    made = F.transform(found, lambda e: F.struct(short(body(e)).alias("label"), F.substring(e, 1, 1).rlike(f"[{SELECTED}]").alias("selected")))
    return F.filter(made, lambda e: label(e["label"]) != "")


def strip_tags(value: Column) -> Column:
    return unescape(F.regexp_replace(value, r"<[^>]+>", " "))


#: Cells and rows of tables.
CELL = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"
ROW = r"(?is)<tr\b[^>]*>.*?</tr>"


def fragment_entries(value: Column) -> Column:
    """text_entries() of each table cell of a fragment in order, or of the whole fragment where it has no cell; tags are no text."""
    cells = F.regexp_extract_all(value, F.lit(CELL), 1)
    of = lambda c: text_entries(strip_tags(c))
    return F.when(F.size(cells) > 0, F.flatten(F.transform(cells, of))).otherwise(of(value))


def _prefixes(c: Column, *, whole: bool) -> Column:
    """A label's beginnings of four letters or more; `whole`: itself too, however short."""
    proper = F.transform(F.sequence(F.lit(4), F.length(c) - 1), lambda n: F.substring(c, F.lit(1), n))
    parts = F.when(F.length(c) > 4, proper).otherwise(F.array().cast("array<string>"))
    return F.concat(parts, F.array(c)) if whole else parts


def _normal(entries: DataFrame) -> Column:
    """The normal form of the entries' labels, which the column `norm` holds where it was worked out before."""
    return F.col("norm") if "norm" in entries.columns else label("label")


def matches(targets: DataFrame, sources: DataFrame, *, page: list[str], on: list[str]) -> DataFrame:
    """page columns, `on`, row_nr: which target labels fit a label of which source row of their page.

    Labels fit if they are equal or the shorter one, of four letters or more, begins
    the longer one. Both ways are equal joins: a whole label meets the beginnings
    of the other side.
    """
    t = targets.select(*page, *on, _normal(targets).alias("_l")).filter("_l <> ''")
    s = sources.select(*page, "row_nr", _normal(sources).alias("_l")).filter("_l <> ''").distinct()
    longer = s.select(*page, "row_nr", F.explode(_prefixes(F.col("_l"), whole=True)).alias("_l")).distinct()
    shorter = t.select(*page, *on, F.explode(_prefixes(F.col("_l"), whole=False)).alias("_l"))
    keys = [*page, "_l"]
    # Merged, as labels and their beginnings are many more than the file sizes let Spark expect.
    return t.join(longer.hint("merge"), keys).unionByName(shorter.join(s.hint("merge"), keys)).select(*page, *on, "row_nr").distinct()


def best_rows(targets: DataFrame, sources: DataFrame, *, page: list[str], target: str, entry: str = "entry_nr") -> DataFrame:
    """page columns, target, row_nr, score: for each target the source row that matches most of its entries.

    `targets`: page columns, target, entry (a number that tells a target's entries
    apart, as labels may repeat), label; `sources`: page columns, row_nr, label.
    Ties go to the first row; a match needs two entries, or all if there is one.
    Targets with the same entries are scored once, against the first of the rows
    with the same labels; rows of a page are not paired.
    """
    fine = targets.select(*page, target, entry, _normal(targets).alias("_l")).filter(F.col("_l") != "")
    for c in (*page, target):
        fine = fine.filter(F.col(c).isNotNull())
    # Both groupings are by target, so rows move once.
    each = fine.repartition(*page, target).groupBy(*page, target, entry).agg(F.array_sort(F.collect_set("_l")).alias("_ls"))
    asked = each.groupBy(*page, target).agg(F.array_sort(F.collect_list("_ls")).alias("_entries"))
    named = sources.select(*page, "row_nr", _normal(sources).alias("_l")).filter("_l <> ''")
    rows = named.groupBy(*page, "row_nr").agg(F.array_sort(F.collect_set("_l")).alias("_ls")).groupBy(*page, "_ls").agg(F.min("row_nr").alias("row_nr"))
    kinds = asked.groupBy(*page, "_entries").agg(F.min(target).alias("_kind"))
    labels = kinds.select(*page, "_kind", F.posexplode("_entries").alias("_nr", "_of")).select(*page, "_kind", "_nr", F.explode("_of").alias("norm"))
    score = matches(labels, rows.select(*page, "row_nr", F.explode("_ls").alias("norm")), page=page, on=["_kind", "_nr"]).groupBy(*page, "_kind", "row_nr").agg(F.count("*").alias("score"))
    best = score.groupBy(*page, "_kind").agg(F.max(F.struct("score", (-F.col("row_nr")).alias("nr"))).alias("m"))
    # Kinds may be as many as targets: what Spark guesses of their size is no ground to send them to the driver.
    scored = kinds.join(best.hint("merge"), [*page, "_kind"]).filter(F.col("m.score") >= F.least(F.lit(2), F.size("_entries")))
    met = asked.join(scored.hint("merge"), [*page, "_entries"])
    return met.select(*page, target, (-F.col("m.nr")).alias("row_nr"), F.col("m.score").alias("score"))


def set_mark(text: Column, name: Column, selected: Column) -> Column:
    """`text` with the marks in front of `name` set to ☑ or ☐."""
    quoted = F.regexp_replace(name, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    off, on = F.concat(F.lit("[☐□](\\s*)"), quoted), F.concat(F.lit("[☑■](\\s*)"), quoted)
    whole = lambda mark: F.concat(F.lit(mark + "$1"), F.regexp_replace(name, r"([\\$])", r"\\$1"))
    return F.when(selected, F.regexp_replace(text, off, whole("☑"))).otherwise(F.regexp_replace(text, on, whole("☐")))


def _options(sources: DataFrame, page: list[str]) -> DataFrame:
    """page columns, row_nr, options: the marked options of each source row, in order."""
    return sources.withColumn("norm", _normal(sources)).groupBy(*page, "row_nr").agg(F.array_sort(F.collect_list(F.struct("entry_nr", "label", "selected", "norm"))).alias("options"))


def _group(labels: Column) -> Column:
    """What a cell and a source row have in common if the cell lacks its first mark only."""
    return F.array_join(labels, "\x01")


def restore_leading(fragments: DataFrame, options: DataFrame, *, page: list[str], text: str) -> DataFrame:
    """Fragments with the first mark put back in cells that hold the options of exactly one source row of the page, and n_restored.

    The row has three options or more and a first label of four letters or more;
    cells and rows meet as equal strings of labels, by a map of the page's rows.
    """
    fit = options.filter((F.size("options") >= 3) & (F.length(F.col("options")[0]["norm"]) >= 4))
    one = fit.groupBy(*page, _group(F.transform("options", lambda o: o["label"])).alias("g")).agg(F.count("*").alias("n"), F.first(F.col("options")[0]["selected"]).alias("on")).filter("n = 1")
    maps = one.groupBy(*page).agg(F.map_from_entries(F.collect_list(F.struct("g", "on"))).alias("_on"))
    parts = F.split(F.regexp_replace(text, r"(?is)(<t[dh]\b[^>]*>)(.*?)(</t[dh]>)", "\x02$1\x03$2\x04$3"), "\x02")
    cell = lambda x: F.regexp_extract(x, "(?s)\x03(.*?)\x04", 1)
    group = lambda x: F.regexp_replace(F.regexp_replace(cell(x), r"^\s+|\s+$", ""), rf"\s*[{MARKS}]\s*", "\x01")
    found = lambda x: F.when(x.contains("\x03"), F.try_element_at("_on", group(x)))
    put = lambda x: F.regexp_replace(x, "(?s)\x03(\\s*)", F.concat(F.lit("$1"), F.when(found(x).isNull(), "").when(found(x), "☑").otherwise("☐")))
    met = fragments.join(maps.hint("merge"), page, "left").withColumn("_parts", parts)
    fixed = F.array_join(F.transform("_parts", lambda x: F.regexp_replace(put(x), "[\x03\x04]", "")), "")
    n = F.size(F.filter("_parts", lambda x: found(x).isNotNull()))
    none = F.col("_on").isNull()
    return met.withColumns({"n_restored": F.when(none, 0).otherwise(n), text: F.when(none, F.col(text)).otherwise(fixed)}).drop("_on", "_parts")


def repair_fragments(fragments: DataFrame, sources: DataFrame, *, page: list[str], target: str, path: str | None = None) -> DataFrame:
    """Fragments (page columns, target, text) with marks set as their best source row has them, and n_changes.

    A fragment's options are set one after the other in order, as later labels
    may begin like earlier ones. With a folder, `path`, what several steps read
    (source entries, fragments, their entries) is worked out once and written there.
    Written files are much smaller than their rows, so joins are merged by name:
    by its guess Spark would send all pages' rows to the driver.
    """
    once = lambda rows, name: rows if path is None else kept(rows, f"{path}/{name}")
    sources = once(sources.withColumn("norm", _normal(sources)), "sources")
    options = _options(sources, page)
    given = restore_leading(fragments.select(*page, target, "text"), options, page=page, text="text").withColumn("_entries", fragment_entries(F.col("text")))
    given = once(given, "given")
    # A label's normal form is worked out once, where the entries stand in rows.
    entries = given.select(*page, target, F.posexplode("_entries").alias("entry_nr", "e")).select(*page, target, "entry_nr", "e.label", label("e.label").alias("norm"))
    entries = once(entries, "entries")
    best = best_rows(entries, sources, page=page, target=target)
    chosen = entries.join(best.hint("merge"), [*page, target]).join(options.hint("merge"), [*page, "row_nr"])
    fit = F.filter("options", lambda s: labels_match(s["norm"], F.col("norm")))
    plans = chosen.withColumn("on", F.get(fit, 0)["selected"]).filter("on IS NOT NULL").groupBy(*page, target).agg(F.array_sort(F.collect_list(F.struct("entry_nr", "label", "on"))).alias("_plan"))
    met = given.join(plans.hint("merge"), [*page, target], "left")
    done = F.when(F.col("_plan").isNull(), F.col("text")).otherwise(F.aggregate("_plan", F.col("text"), lambda acc, p: set_mark(acc, p["label"], p["on"])))
    marks = lambda c: F.regexp_replace(c, f"[^{MARKS}]", "")
    out = met.withColumn("fixed", done)
    changed = F.size(F.filter(F.zip_with(F.split(marks(F.col("text")), ""), F.split(marks(F.col("fixed")), ""), lambda a, b: a != b), lambda x: x))
    return out.select(*page, target, F.col("fixed").alias("text"), (F.col("n_restored") + F.when(F.col("text") == F.col("fixed"), 0).otherwise(changed)).alias("n_changes"))


def repair(values: DataFrame, sources: DataFrame, *, page: list[str], target: str, path: str | None = None) -> DataFrame:
    """Values (page columns, target, text) with marks set right, and n_changes; `path` as for repair_fragments().

    The rows of a table are repaired one by one; a value without table rows, or
    with rows of which none changes, is repaired as a whole.
    """
    text = F.coalesce("text", F.lit(""))
    table = F.lower(text).contains("<tr")
    cut = F.split(F.regexp_replace(text, f"({ROW})", "\x01$1\x01"), "\x01")
    whole = F.array(F.struct(F.lit(-1).alias("_nr"), text.alias("text")))
    pieces = F.when(table, F.concat(whole, F.transform(cut, lambda x, i: F.struct(i.alias("_nr"), x.alias("text"))))).otherwise(whole)
    rows = values.select(*page, target, F.explode(pieces).alias("p")).select(*page, F.struct(target, "p._nr").alias("_piece"), "p.text")
    asked = (F.col("_piece._nr") == -1) | F.col("text").rlike(f"^{ROW}$")
    fixed = repair_fragments(rows.filter(asked), sources, page=page, target="_piece", path=path).unionByName(rows.filter(~asked).withColumn("n_changes", F.lit(0)))
    of = F.struct(F.col("_piece._nr").alias("nr"), "text", "n_changes")
    got = fixed.groupBy(*page, F.col(f"_piece.{target}").alias(target)).agg(F.array_sort(F.collect_list(of)).alias("ps"))
    inner = F.filter("ps", lambda x: x["nr"] >= 0)
    n = F.aggregate(inner, F.lit(0), lambda acc, x: acc + x["n_changes"])
    by_row = n > 0
    return got.select(*page, target, F.when(by_row, F.array_join(F.transform(inner, lambda x: x["text"]), "")).otherwise(F.col("ps")[0]["text"]).alias("text"), F.when(by_row, n).otherwise(F.col("ps")[0]["n_changes"]).alias("n_changes"))
