"""The projection's golden cases: modes, empty text, titles, figures, rendering."""

import pytest

from leafwise.functions.text import clean_text
from leafwise.operators import project, render, sections

SCHEMA = (
    "doc_id int, block_seq int, type string, text string, text_level int, page_idx int, list_items array<string>, table_caption array<string>, table_body string, "
    "table_footnote array<string>, img_path string, img_caption array<string>, image_caption array<string>, content string, img_footnote array<string>, image_seq int, had_text boolean, had_table boolean"
)


def frame(spark, rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({"doc_id": 1, "block_seq": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], SCHEMA)


#: A page with every kind of block, in an order of its own, and what each gives: (block, text of the plain mode, whether it is shown untyped).
BLOCKS = [
    ({"type": "footer", "text": "p. 5 of 9", "page_idx": 4}, "p. 5 of 9", False),
    ({"type": "image", "img_footnote": ["by hand"], "page_idx": 4}, "by hand", True),
    ({"type": "equation", "text": "F = ma", "page_idx": 4}, "F = ma", True),
    ({"type": "aside", "text": "not a known kind", "page_idx": 4}, None, False),
    ({"type": "text", "text": "Pumps", "text_level": 2, "page_idx": 5}, "Pumps", True),
    ({"type": "image", "img_path": "p/7.jpg", "img_caption": ["A pump", "rotor"], "image_caption": ["A pump"], "content": "rotor", "img_footnote": ["1:20"], "image_seq": 8, "page_idx": 5}, "A pump\nrotor\n1:20", True),
    ({"type": "table", "table_body": "<table><tr><td>7 kW</td></tr></table>", "table_footnote": ["rated"], "page_idx": 5}, "<table><tr><td>7 kW</td></tr></table>\nrated", True),
    ({"type": "header", "text": "Manual", "page_idx": 6}, "Manual", False),
    ({"type": "text", "text": "\tuse with care ", "page_idx": 6}, "\tuse with care ", True),
    ({"type": "list", "list_items": ["oil", "grease", "wax"], "page_idx": 6}, "oil\ngrease\nwax", True),
    ({"type": "page_number", "text": "7", "page_idx": 6}, None, False),
]
FIGURE = {"images": "rotor of brass", "two_stage": "A pump\n1:20\nrotor of brass"}


def projected(spark, rows, mode="plain", chunk_type=False, vision=None):
    b = frame(spark, rows)
    if mode == "images":
        from pyspark.sql import functions as F

        b = b.withColumn("stored_text", F.when(F.col("image_seq") == 8, "\n rotor of brass "))
    if mode == "two_stage":
        b = project.merge_vision(b, spark.createDataFrame(vision or [], "doc_id int, image_seq int, vision_text string"))
    return project.project(b, mode=mode, chunk_type=chunk_type)


@pytest.mark.parametrize("mode", ["plain", "images", "two_stage"])
@pytest.mark.parametrize("typed", [False, True])
def test_every_kind_in_every_mode(spark, mode, typed):
    out = projected(spark, [b for b, _, _ in BLOCKS], mode, typed, [(1, 8, "rotor of brass")])
    got = {r.block_seq: (r.text, r.page_number, r.type) for r in out.collect()}
    want = {}
    for i, (block, text, untyped) in enumerate(BLOCKS):
        if text is None or not (typed or untyped):
            continue
        figure = block["type"] == "image"
        # in the mode of stored texts and answers a figure without a file gives its printed notes
        text = FIGURE.get(mode, text) if block.get("img_path") else text
        kind = block["type"] if block["type"] in ("header", "footer") else "title" if "text_level" in block else "image" if figure and mode != "plain" else None
        want[i] = (text, block["page_idx"] + 1, kind if typed else None)
    assert got == want
    pieces = [want[i] for i in sorted(want)]
    assert render.plain_text(out).first().txt == "".join(t.strip() + ("\n\n" if k == "title" else "\n") for t, _, k in pieces).rstrip("\n")


def test_empty_after_cleaning(spark):
    rows = [dict(type="text", text="", had_text=True, page_idx=0), dict(type="table", table_caption=[""], had_table=True, page_idx=0), dict(type="list", list_items=[""], page_idx=0), dict(type="header", text="", page_idx=0)]
    assert projected(spark, rows, "plain", True).count() == 0
    assert [(r.text, r.page_number) for r in projected(spark, rows, "images", True).collect()] == [("", 1), ("", 1)]
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    assert {r.txt for r in render.plain_text(projected(spark, rows, "images"), docs).collect()} == {""}


def test_missing_answer_raises(spark):
    with pytest.raises(Exception, match="Missing or empty vision result for seq=41"):
        projected(spark, [dict(type="image", img_path="x/y.png", image_seq=41, page_idx=2)], "two_stage").collect()


def test_unselected_figure_keeps_its_body(spark):
    rows = [dict(type="image", img_path="g.gif", img_caption=["Mill", "a sketch"], content="a sketch", page_idx=2)]
    assert [(r.text, r.page_number, r.type) for r in projected(spark, rows, "two_stage", True).collect()] == [("Mill\na sketch", 3, "image")]


def test_only_text_becomes_title(spark):
    rows = [dict(type="table", table_body="9 %", text_level=3), dict(type="equation", text="a > b", text_level=0), dict(type="list", list_items=["one", "two"], text_level=2)]
    out = projected(spark, rows, "plain", True)
    assert {(r.type, r.page_number) for r in out.collect()} == {(None, 1)}
    assert render.plain_text(out).first().txt == "9 %\na > b\none\ntwo"


def test_normalize(spark):
    """Each parser type becomes one that projection knows; boxes are scaled by each page's own size, where it is known."""
    from pyspark.sql import functions as F

    fields = "doc_id int, block_seq int, page_idx int, type string, text string, image_caption array<string>, chart_caption array<string>, chart_footnote array<string>, content string, code_caption array<string>, code_body string, list_items array<string>"
    given = [
        (7, 0, 2, "chart", None, None, ["Yield by year", "t/ha"], ["estimated"], "2019 rises", None, None, None),
        (7, 1, 2, "image", None, [], None, None, None, None, None, None),
        (7, 2, 3, "code", None, None, None, None, None, ["Listing 4"], "SELECT 1;", None),
        (7, 3, 3, "index", None, None, None, None, None, None, None, ["Soil ... 3", "Water ... 9"]),
        (7, 4, 5, "page_footnote", "see annex B", None, None, None, None, None, None, None),
        (7, 5, 5, "table", "kept", None, None, None, None, None, None, None),
    ]
    blocks = spark.createDataFrame(given, fields).withColumn("bbox", F.array(*map(F.lit, (0.0, 250.0, 1000.0, 300.0))))
    pages = spark.createDataFrame([(7, 2, 420.0, 595.0), (7, 3, 842.0, 1191.0), (8, 5, 1.0, 1.0)], "doc_id int, page_idx int, width_pt double, height_pt double")
    rows = {r.block_seq: r for r in project.normalize(blocks, pages).collect()}
    assert [rows[k].type for k in range(6)] == ["image", "image", "text", "list", "text", "table"]
    assert rows[0].img_caption == ["Yield by year", "t/ha", "2019 rises"] and rows[0].img_footnote == ["estimated"]
    assert rows[1].img_caption == [] and rows[2].text == "Listing 4\nSELECT 1;" and rows[3].list_items == ["Soil ... 3", "Water ... 9"] and rows[4].text == "see annex B"
    assert rows[0].bbox == pytest.approx([0, 148.75, 420, 178.5]) and rows[2].bbox == pytest.approx([0, 297.75, 842, 357.3]) and rows[2].page_size == [842, 1191]
    assert rows[4].bbox == [0, 250, 1000, 300] and rows[4].page_size is None


@pytest.mark.parametrize("first,last", [(-1, None), (2, 1), (True, None)])
def test_page_ranges(spark, first, last):
    with pytest.raises(ValueError):
        project.page_range(frame(spark, [b for b, _, _ in BLOCKS]), first, last)


def test_sections(spark):
    rows = [dict(type="text", text=t, text_level=n) for t, n in (("Intro", 1), ("a", None), ("5. References", 1), ("b", None), ("End", 1), ("c", None))]
    assert [r.text for r in sorted(sections.without_sections(frame(spark, rows)).collect(), key=lambda r: r.block_seq)] == ["Intro", "a", "End", "c"]


def test_markdown(spark):
    rows = [dict(type="text", text="Head", text_level=1), dict(type="list", list_items=["a", " b "]), dict(type="table", table_caption=["T"], table_body="x"), dict(type="image", img_caption=["I"]), dict(type="other", text=" t ")]
    assert render.markdown(frame(spark, rows)).first().markdown == "## Head\n\n- a\n- b\n\nT\n\nx\n\nI\n\nt"
