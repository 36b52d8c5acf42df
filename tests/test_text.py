import pytest
from pyspark.sql import functions as F

from leafwise.functions import text as T
from leafwise.sources.content import content_blocks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize("given,want", [("Ζεύς 🜁\r\n ok", "Ζεύς 🜁\r\n ok"), ("\udc00x\udbffy", "xy"), ("q" + chr(0xDBFF), "q"), ("\x7f\U0001f000", "\x7f\U0001f000"), (None, "")])
def test_clean(given, want):
    assert T.clean_text(given) == want


#: One case for each wrapper, alone and over others, and one of a text that only looks like one.
SANITIZE = [
    ("  <THINK>the axis\nis cut off</think>\n\nHERE ARE THE KEY FINDINGS: Load rises.", "Load rises."),
    ("根据提供的上下文信息，泵压为 3 bar", "泵压为 3 bar"),
    ("image description:\n[page 14] [chunktype=Body] Flow chart\n  of a mill  ", "Flow chart\nof a mill"),
    ("The key findings: two peaks\nHere is the summary: none", "The key findings: two peaks\nHere is the summary: none"),
]


@pytest.mark.parametrize("given,want", SANITIZE)
def test_sanitize(spark, given, want):
    assert one(spark, given, T.sanitize) == want


def test_sanitize_unclosed_and_strict(spark):
    with pytest.raises(Exception, match="Incomplete"):
        one(spark, "\n<think>the legend reads", T.sanitize)
    printed = "Image Description: a label\n[Page 3] <think>as printed"
    assert one(spark, f"  {printed} ", lambda c: T.sanitize(c, strict=True)) == printed


def test_strip_is_unicode_aware(spark):
    for x in ("　a ", "\x1ca\x1f", " a\t\n", " a b "):
        assert one(spark, x, T.strip) == x.strip()


def test_lines(spark):
    for x in ("a\r\nb c\x85d e", "a\n\nb", "x\x0by"):
        assert one(spark, x, T.lines) == x.splitlines()


@pytest.mark.parametrize("given,want", [("1. References", True), ("preferences", True), ("R E F E R E N C E S:", True), ("Reference list of things", False), ("VII Acknowledgments.", True), ("", False), (None, False)])
def test_headings(spark, given, want):
    assert one(spark, given, T.is_dropped_heading) is want


def test_small_helpers(spark):
    assert one(spark, '["a", " b "]', T.url_list) == ["a", "b"] and one(spark, "a, ,b", T.url_list) == ["a", "b"]
    assert [one(spark, x, T.tier) for x in ("pipeline", "VLM-x", "flash", "other", "", None)] == ["basic", "advanced", "flash", "standard", "advanced", "advanced"]
    assert one(spark, "a/b\\c.txt", lambda c: T.safe_filename(c, ".docx")) == "c.txt.docx"
    assert one(spark, "gpt-4.1 mini", T.member_name) == "GPT_4_1_MINI"
    assert one(spark, " a &amp; <b>c</b>：", T.label) == "a&c"


def test_content_lists(spark):
    body = '[{"type": "text", "text": "a\\ud800b\\ud83d\\ude42"}, {"type": "image", "img_path": "f", "img_caption": "one", "image_caption": [], "page_idx": 3}, {"type": "image", "image_caption": null}]'
    rows = content_blocks(spark.createDataFrame([(1, body), (2, "broken"), (3, None)], "doc_id int, body string")).orderBy("block_seq").collect()
    assert [r.block_seq for r in rows] == [0, 1, 2]
    assert rows[0].text == "ab🙂" and rows[0].image_caption is None
    assert rows[1].img_caption == ["one"] and rows[1].image_caption == [] and rows[1].page_idx == 3
    assert rows[2].image_caption == []
