"""Figures and tables with captions in Markdown: attribute lists, labels, numbers, blocks, references. Column code over one text; no shuffle.

A figure is an image with a caption, `![caption](path){#fig:x .wide key="a b"}`. A
table's caption is a line `: caption {#tbl:x}` before a table. Figures without a
label have no number; tables without one are labelled by the number they get.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.functions.text import strip
from leafwise.operators.render import REFERENCE

#: The tokens of an attribute list; quotes of one kind may stand within the other, or behind a backslash.
_VALUE = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[^\s}\"']+"
_TOKEN = rf"#[^\s}}\"'=]+|\.[^\s}}\"'=]+|[\w:-]+=(?:{_VALUE})"
_LIST = rf"\{{(?:\s*(?:{_TOKEN}))+\s*\}}"
#: A caption may hold brackets in pairs; a path ends at a blank or the closing bracket, and a title in quotes may follow.
_TEXT = r"(?:[^\[\]\\]|\\.|\[[^\[\]]*\])"
FIGURE = rf"!\[({_TEXT}+)\]\(([^()\s]+)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\)({_LIST})?"
TABLE = rf"(?m)^:[ \t]+([^\n]*?)[ \t]*({_LIST})?[ \t]*$(?=\n(?:[ \t]*\n)*[ \t]*[|+])"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: a column that is named again within a lambda is worked out again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def attributes(given: Column) -> Column:
    """struct(label, classes, pairs) of an attribute list: the last `#label` (NULL: none), the classes in order, and keys with their values without quotes; a key's last value counts."""
    return _once(F.regexp_extract_all(F.coalesce(given, F.lit("")), F.lit(f"({_TOKEN})"), 1), _of_tokens)


def _of_tokens(tokens: Column) -> Column:
    of = lambda mark: F.transform(F.filter(tokens, lambda t: t.startswith(mark)), lambda t: F.substring(t, F.lit(2), F.length(t)))
    bare = lambda v: F.when(v.rlike(r"^[\"']"), F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(v)
    pair = lambda t: _once(F.regexp_extract(t, r"^([\w:-]+)=", 1), lambda k: F.struct(k.alias("key"), _once(F.substring(t, F.length(k) + 2, F.length(t)), bare).alias("value")))
    named = F.transform(F.filter(tokens, lambda t: ~t.rlike(r"^[#.]")), pair)
    # Of equal keys the last one stays.
    last = _once(named, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps) + 1), lambda q: q["key"] == p["key"])))
    return F.struct(F.try_element_at(of("#"), F.lit(-1)).alias("label"), of(".").alias("classes"), F.map_from_entries(last).alias("pairs"))


def _found(text: Column, pattern: str, *groups: str) -> Column:
    """Array of structs: what each group of each match holds; empty where it took no part."""
    each = lambda n: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), n)
    return F.arrays_zip(*[each(n).alias(g) for n, g in enumerate(groups, 1)])


def figures(text: Column) -> Column:
    """Array of struct(caption, path, label, classes, pairs, number) of the figures in a text, in order; figures of one label share its number."""
    found = F.transform(_found(text, FIGURE, "caption", "path", "attrs"), lambda m: F.struct(strip(m["caption"]).alias("caption"), m["path"].alias("path"), attributes(m["attrs"]).alias("a")))
    found = F.filter(found, lambda m: m["caption"] != "")
    labels = lambda ms: F.array_distinct(F.filter(F.transform(ms, lambda m: m["a"]["label"]), lambda x: x.isNotNull()))
    number = lambda m, known: F.when(m["a"]["label"].isNotNull(), F.array_position(known, m["a"]["label"]).cast("int"))
    told = lambda m, known: F.struct(m["caption"].alias("caption"), m["path"].alias("path"), m["a"]["label"].alias("label"), m["a"]["classes"].alias("classes"), m["a"]["pairs"].alias("pairs"), number(m, known).alias("number"))
    return _once(found, lambda ms: _once(labels(ms), lambda known: F.transform(ms, lambda m: told(m, known))))


def tables(text: Column) -> Column:
    """Array of struct(caption, label, number) of the captioned tables in a text, in order.

    Labels begin with `tbl:`; one without gets it in front, and a table without a
    label that of the next number. A label that is there already keeps its number.
    """
    found = F.filter(_found(text, TABLE, "caption", "attrs"), lambda m: strip(m["caption"]) != "")
    given = F.transform(found, lambda m: F.struct(strip(m["caption"]).alias("caption"), attributes(m["attrs"])["label"].alias("label")))
    start = F.struct(F.array().cast("array<string>").alias("labels"), F.array().cast("array<string>").alias("own"))

    def step(acc: Column, m: Column) -> Column:
        named = F.when(m["label"].isNull(), F.concat(F.lit("tbl:"), F.size(acc["labels"]) + 1)).when(m["label"].startswith("tbl:"), m["label"]).otherwise(F.concat(F.lit("tbl:"), m["label"]))
        labels = F.when(F.array_contains(acc["labels"], named), acc["labels"]).otherwise(F.concat(acc["labels"], F.array(named)))
        return F.struct(labels.alias("labels"), F.concat(acc["own"], F.array(named)).alias("own"))

    told = lambda m, label, labels: F.struct(m["caption"].alias("caption"), label.alias("label"), F.array_position(labels, label).cast("int").alias("number"))
    return _once(given, lambda ms: _once(F.aggregate(ms, start, step), lambda own: F.transform(ms, lambda m, i: told(m, F.get(own["own"], i), own["labels"]))))


def with_captions(texts: DataFrame, *, text: str = "text") -> DataFrame:
    """`texts` with figures and tables (arrays as above)."""
    return texts.withColumns({"figures": figures(F.col(text)), "tables": tables(F.col(text))})


def label_map(figures: Column, tables: Column) -> Column:
    """Map from label to number; of a label that figures and tables share, the figures' number."""
    entry = lambda c: F.transform(F.filter(c, lambda x: x["number"].isNotNull()), lambda x: F.struct(x["label"].alias("key"), x["number"].alias("value")))
    firsts = F.array_distinct(entry(figures))
    more = F.filter(F.array_distinct(entry(tables)), lambda e: ~F.exists(firsts, lambda f: f["key"] == e["key"]))
    return F.map_from_entries(F.concat(firsts, more))


def referenced(text: Column, labels: Column) -> Column:
    """The text, in which `[@fig:x]` and `[@tbl:x]` of a known label read as its name and number; others stay as they are."""
    named = F.create_map(*[F.lit(x) for pair in REFERENCE.items() for x in pair])
    marks = F.split(F.regexp_replace(text, r"\[@([\w:.-]+)\]", "\x01@$1\x01"), "\x01")

    def shown(x: Column) -> Column:
        label = F.substring(x, F.lit(2), F.length(x))
        said = F.concat(F.try_element_at(named, F.regexp_extract(label, "^([A-Za-z]+):", 1)), F.try_element_at(labels, label).cast("string"))
        return F.when(x.startswith("@"), F.coalesce(said, F.concat(F.lit("["), x, F.lit("]")))).otherwise(x)

    return F.when(text.contains("[@"), F.array_join(F.transform(marks, shown), "")).otherwise(text)


def figure_block(figure: Column) -> Column:
    """A figure as a block of its own: the image, its caption below, and the attributes around both."""
    quoted = lambda v: F.concat(F.lit('"'), F.regexp_replace(v, r"([\"\\])", r"\\$1"), F.lit('"'))
    pairs = F.transform(F.map_entries(figure["pairs"]), lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), quoted(e["value"])))
    classes = F.transform(figure["classes"], lambda c: F.concat(F.lit(" ."), c))
    head = F.concat(F.lit("::: {"), F.coalesce(F.concat(F.lit("#"), figure["label"], F.lit(" ")), F.lit("")), F.lit(".figure"), F.array_join(classes, ""), F.array_join(pairs, ""), F.lit("}"))
    return F.concat(head, F.lit("\n![]("), figure["path"], F.lit(")\n\n"), figure["caption"], F.lit("\n:::"))
