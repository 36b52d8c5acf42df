"""Figure modes, format sets, listings and the Markdown sink."""

import pytest
from pyspark.sql import functions as F

from leafwise.functions import text as T
from leafwise.operators import figures, ledger, providers, render
from leafwise.schema import conform

BLOCKS = "doc_id int, block_seq int, type string, text string, page_idx int, img_path string, img_caption array<string>, img_footnote array<string>"
ROWS = [
    (1, 0, "text", "before", 0, None, None, None),
    (1, 1, "image", None, 0, "a", ["caption a"], ["note a"]),
    (1, 2, "image", None, 0, "tiny", None, None),
    (1, 3, "text", "after", 1, None, None, None),
    (1, 4, "image", None, 1, "a", ["caption a"], None),
]
FILES = [(1, "a", "sa", 400, 300, 50_000), (1, "tiny", "st", 20, 20, 100)]


@pytest.fixture()
def given(spark):
    return conform(spark.createDataFrame(ROWS, BLOCKS)), spark.createDataFrame(FILES, "doc_id int, img_path string, sha256 string, width int, height int, size int")


def test_every_figure_or_selected_ones(given):
    chosen = lambda **kw: {r.block_seq: r for r in figures.image_jobs(*given, **kw).collect()}
    assert sorted(chosen()) == [1, 4] and sorted(chosen(every=True)) == [1, 2, 4]
    assert [chosen(every=True)[k].image_seq for k in (1, 2, 4)] == [1, 2, 3]


def test_strict_requests_hold_no_captions(given):
    rows = {r.block_seq: r for r in figures.image_jobs(*given, strict=True, every=True).collect()}
    assert rows[1].prompt == "Context before: [Page 1] [ChunkType=Body] before\nContext after: [Page 2] [ChunkType=Body] after"
    assert {r.base_text for r in rows.values()} == {""} and rows[1].key != rows[4].key
    usual = {r.block_seq: r for r in figures.image_jobs(*given, every=True).collect()}
    assert usual[1].prompt.startswith("Image caption (Page 1): caption a") and usual[1].base_text == "caption a\nnote a"
    assert "caption a" in usual[2].prompt  # a figure's captions are context for its neighbours


def test_strict_answers_stand_alone(given):
    @providers.register("reader")
    def reader(prompts):
        return prompts.map(lambda p: "Here is the summary: 12.5 kV")

    got = {r.block_seq: r.text for r in providers.parse_with_images(*given, providers=["reader"], strict=True, every=True).collect()}
    assert got[1] == "Here is the summary: 12.5 kV"
    usual = {r.block_seq: r.text for r in providers.parse_with_images(*given, providers=["reader"]).collect()}
    assert usual[1] == "caption a\nnote a\n12.5 kV"


def test_formats(spark):
    df = spark.createDataFrame([(" PDF, .docx,pdf",), ("all",), ("..png",)], "w string")
    got = [r.f for r in df.select(T.chosen_formats("w").alias("f")).collect()]
    assert got[0] == [".docx", ".pdf"] and got[2] == [".png"] and got[1] == sorted(f".{f}" for f in {*T.PAGE_FORMATS, *T.OFFICE_FORMATS})
    with pytest.raises(Exception, match=r"Unsupported extensions: \.exe, \.txt"):
        spark.createDataFrame([("pdf,txt,exe",)], "w string").select(T.chosen_formats("w")).collect()


def test_listing_and_catalog(spark):
    jobs = spark.createDataFrame([("b", "FAILURE", "boom"), ("a", "SUCCESS", None)], "job_id string, state string, error string")
    assert [tuple(r) for r in ledger.listing(jobs).collect()] == [("a", "SUCCESS"), ("b", "FAILURE")]
    models = spark.createDataFrame([("x", "m2"), ("x", "m1"), ("x", "m2"), ("y", None), ("z", "m")], "g string, m string")
    assert {r.g: r.models for r in ledger.catalog(models, group="g", name="m").collect()} == {"x": ["m1", "m2"], "z": ["m"]}


def test_markdown_files(spark, tmp_path):
    rows = [("a b", "# T\n\nline\n"), ("c", None), ("d", "é\r\nx")]
    render.write_markdown(spark.createDataFrame(rows, "doc_id string, markdown string"), f"{tmp_path}/m")
    assert sorted(map(tuple, render.read_markdown(spark, f"{tmp_path}/m").collect())) == [("a b", "# T\n\nline\n"), ("c", ""), ("d", "é\r\nx")]


def test_context_forms_share_their_windows(spark):
    from leafwise.operators.context import context

    df = spark.createDataFrame([(1, i, None if i % 3 == 1 else f"L{i}") for i in range(9)], "g int, o int, line string").withColumn("low", F.lower("line"))
    got = {r.o: (r.before, r.after, r.b, r.a) for r in context(df, group="g", order="o", line="line", at=F.col("o") % 3 == 1, also={"low": ("b", "a")}).collect()}
    assert got[4] == ("L2\nL3", "L5\nL6", "l2\nl3", "l5\nl6") and got[7] == ("L5\nL6", "L8", "l5\nl6", "l8")
