"""Checkbox repair: visual rows, best rows, plain texts and tables."""

from pyspark.sql import functions as F

from leafwise.operators import reconcile


def words_of(spark, *rows):
    return spark.createDataFrame([(1, float(y), float(x), t) for y, x, t in rows], "page int, y_min double, x_min double, text string")


def sources_of(spark, *rows):
    return reconcile.source_entries(reconcile.visual_rows(words_of(spark, *rows), page=["page"]), page=["page"])


def test_rows_start_where_the_anchor_is_left(spark):
    words = words_of(spark, (10, 5, "b"), (12, 1, "a"), (13, 9, "c"), (13.5, 0, "d"), (16, 3, "e"), (40, 1, "f"), (40, 1, "f"))
    got = sorted((r.row_nr, r.words) for r in reconcile.visual_rows(words, page=["page"]).collect())
    assert got == [(0, ["a", "b", "c"]), (1, ["d", "e"]), (2, ["f", "f"])]


def test_every_entry_of_a_target_counts(spark):
    targets = spark.createDataFrame([(1, "t", 0, "Blue"), (1, "t", 1, "Blue"), (1, "t", 2, "Gray"), (1, "u", 0, "Rose"), (1, "u", 1, "Mint"), (1, "v", 0, "Ivory white")], "page int, target string, entry_nr int, label string")
    sources = spark.createDataFrame([(1, 0, "Blue"), (1, 0, "Rose"), (1, 1, "Ivory")], "page int, row_nr int, label string")
    got = {r.target: (r.row_nr, r.score) for r in reconcile.best_rows(targets, sources, page=["page"], target="target").collect()}
    assert got == {"t": (0, 2), "v": (1, 1)}  # u matches one entry of two


def test_marks_of_plain_texts(spark):
    sources = sources_of(spark, (10, 1, "□Monday"), (10, 2, "■Tuesday"), (10, 3, "☑"), (10, 4, "Friday"))
    values = spark.createDataFrame([(1, 0, "Day: ☐Monday ☐Tuesday ☐Friday"), (1, 1, "no marks"), (1, 2, "☐Monday ☐Sunday ☐Noon"), (1, 3, None)], "page int, nr int, text string")
    got = {r.nr: (r.text, r.n_changes) for r in reconcile.repair(values, sources, page=["page"], target="nr").collect()}
    assert got == {0: ("Day: ☐Monday ☑Tuesday ☑Friday", 2), 1: ("no marks", 0), 2: ("☐Monday ☐Sunday ☐Noon", 0), 3: ("", 0)}


def test_marks_of_table_rows(spark):
    sources = sources_of(spark, (10, 1, "■Oak"), (10, 2, "□Elm"), (30, 1, "□Granite"), (30, 2, "■Marble"), (30, 3, "□Slate"))
    table = "<table><tr><td>Wood</td><td>☐Oak ☐Elm</td></tr><TR><td>Stone</td><td>☐Granite ☐Marble ☐Slate</td></TR></table>"
    lost = "<table><tr><th>Stone</th><td> Granite ☐Marble ☐Slate</td></tr></table>"
    values = spark.createDataFrame([(1, 0, table), (1, 1, lost), (2, 0, table)], "page int, nr int, text string")
    got = {(r.page, r.nr): (r.text, r.n_changes) for r in reconcile.repair(values, sources, page=["page"], target="nr").collect()}
    assert got[1, 0] == (table.replace("☐Oak", "☑Oak").replace("☐Marble", "☑Marble"), 2)
    assert got[1, 1] == ("<table><tr><th>Stone</th><td> ☐Granite ☑Marble ☐Slate</td></tr></table>", 2)
    assert got[2, 0] == (table, 0)


def test_a_lost_mark_needs_one_row_that_fits(spark):
    rows = [(10, 1, "■Granite"), (10, 2, "■Marble"), (10, 3, "□Slate"), (30, 1, "□Granite"), (30, 2, "■Marble"), (30, 3, "□Slate")]
    value = "<td>Granite ☑Marble ☐Slate</td>"
    values = spark.createDataFrame([(1, 0, value)], "page int, nr int, text string")
    assert reconcile.repair(values, sources_of(spark, *rows), page=["page"], target="nr").first().text == value
    assert reconcile.repair(values, sources_of(spark, *rows[3:]), page=["page"], target="nr").first().text == "<td>☐Granite ☑Marble ☐Slate</td>"


def test_marks_present(spark):
    df = spark.createDataFrame([("☐x", None), ("x", "y"), (None, "a ■")], "a string, b string")
    assert [r.m for r in df.select(reconcile.has_mark(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, True]


def _joined_rows(df):
    """Rows that each join of the run plan made."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if "Join" in name:
            out.append(plan.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_rows_of_a_large_page_are_not_paired(spark):
    n, names = 1500, ("Brand#1", "Brand#13", "Rose", "Mint")
    kinds = [(names[i % 4], names[i // 4 % 3], i) for i in range(n)]
    targets = spark.createDataFrame([(1, i, nr, label) for a, b, i in kinds for nr, label in enumerate((a, b, a))], "page int, target int, entry_nr int, label string")
    sources = spark.createDataFrame([(1, i, label) for a, b, i in kinds for label in (b, a)], "page int, row_nr int, label string")
    best = reconcile.best_rows(targets, sources, page=["page"], target="target")
    got = {r.target: (r.row_nr, r.score) for r in best.collect()}
    fits = lambda x, y: x == y or min(len(x), len(y)) >= 4 and (x.startswith(y) or y.startswith(x))
    want = {}
    for a, b, i in kinds:
        score, row = max((sum(fits(x, c) or fits(x, d) for x in (a, b, a)), -j) for c, d, j in kinds[:12])
        want[i] = (-row, score)
    assert got == want
    assert max(_joined_rows(best)) <= 2 * n


def test_repair_sends_no_pages_to_the_driver(spark, tmp_path):
    sources = sources_of(spark, (10, 1, "■Oak"), (10, 2, "□Elm"))
    values = spark.createDataFrame([(1, 0, "<table><tr><td>☐Oak ☐Elm</td></tr></table>")], "page int, nr int, text string")
    out = reconcile.repair(values, sources, page=["page"], target="nr", path=f"file://{tmp_path}/repair")
    assert out.first().n_changes == 1
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
