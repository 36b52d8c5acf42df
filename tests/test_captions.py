"""Attribute lists, captions, label numbers and references of Markdown texts."""

import time

from pyspark.sql import functions as F

from leafwise.operators import captions


def attrs(spark, *lists):
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(lists)], "i int, a string").select("i", captions.attributes(F.col("a")).alias("a")).orderBy("i").collect()
    return [(r.a.label, r.a.classes, r.a.pairs) for r in rows]


def test_attribute_lists(spark):
    got = attrs(
        spark, "{#fig:pump .wide .left width=50% alt=\"a 'b' c\"}", "{.only}", "{#x key='say \"hi\"' other=\"back\\\\slash \\\"q\\\"\"}", None, "{}", "{#a #b k=1 k=2}", "{ .spaced   #z }"
    )
    assert got == [
        ("fig:pump", ["wide", "left"], {"width": "50%", "alt": "a 'b' c"}), (None, ["only"], {}), ("x", [], {"key": 'say "hi"', "other": 'back\\slash "q"'}),
        (None, [], {}), (None, [], {}), ("b", [], {"k": "2"}), ("z", ["spaced"], {}),
    ]


TEXT = """Intro [@fig:b] and [@tbl:rates], not [@sec:x] nor [@fig:none].

![First [a] pump](one.png){#fig:a .wide title="x } y"} text ![](bare.png) ![No label](two.png "Title")

![Again](three.png){#fig:b} ![Same](four.png){#fig:a}

: Rates of flow {#rates}

| a | b |
|---|---|

: No table follows {#tbl:lost}

Words.

: Without a label
| c |

: Second use {#tbl:rates}

+---+
"""


def test_figures_and_tables_of_a_text(spark):
    df = captions.with_captions(spark.createDataFrame([(1, TEXT), (2, None), (3, "plain")], "doc_id int, text string"))
    row, none, plain = df.orderBy("doc_id").collect()
    assert [(f.caption, f.path, f.label, f.number) for f in row.figures] == [("First [a] pump", "one.png", "fig:a", 1), ("No label", "two.png", None, None), ("Again", "three.png", "fig:b", 2), ("Same", "four.png", "fig:a", 1)]
    assert row.figures[0].classes == ["wide"] and row.figures[0].pairs == {"title": "x } y"}
    assert [(t.caption, t.label, t.number) for t in row.tables] == [("Rates of flow", "tbl:rates", 1), ("Without a label", "tbl:2", 2), ("Second use", "tbl:rates", 1)]
    assert none.figures == none.tables == plain.figures == plain.tables == []


def test_references_read_the_texts_own_labels(spark):
    df = captions.with_captions(spark.createDataFrame([(1, TEXT)], "doc_id int, text string"))
    out = df.select(captions.referenced(F.col("text"), captions.label_map(F.col("figures"), F.col("tables"))).alias("t")).first().t
    assert out.startswith("Intro 图2 and 表1, not [@sec:x] nor [@fig:none].")


def test_figure_blocks(spark):
    text = "![Cap](p.png){#fig:q .a k='v \"w\"'} ![Plain](r.png)"
    df = captions.with_captions(spark.createDataFrame([(text,)], "text string"))
    out = df.select(F.transform("figures", captions.figure_block).alias("b")).first().b
    assert out == ['::: {#fig:q .figure .a k="v \\"w\\""}\n![](p.png)\n\nCap\n:::', "::: {.figure}\n![](r.png)\n\nPlain\n:::"]


def test_long_texts_take_time_in_proportion(spark):
    def seconds(n):
        lines = "".join(f"![Cap {i}](f.png){{#fig:{i % 50} .c alt='say \"{i}\"'}}\n\n: Table {i} {{#{i % 50}}}\n\n| x |\n\n: Bare {i}\n\n| x |\n\n" for i in range(n))
        began = time.time()
        row = captions.with_captions(spark.createDataFrame([(1, lines)], "doc_id int, text string")).first()
        assert [(f.caption, f.label, f.number, f.pairs) for f in row.figures] == [(f"Cap {i}", f"fig:{i % 50}", i % 50 + 1, {"alt": f'say "{i}"'}) for i in range(n)]
        assert len(row.tables) == 2 * n and row.tables[-1].number == len({t.label for t in row.tables})
        return time.time() - began

    seconds(2)
    assert seconds(400) < 10
