"""Figure jobs, prompts, page ranges, articles, Markdown helpers and content lists."""

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from leafwise.functions import identity, prompts
from leafwise.operators import context, figures, metrics, project, providers, render
from leafwise.schema import BLOCK_FIELDS
from leafwise.sources.content import content_blocks


def blocks_of(spark, rows, doc=1):
    """Rows as dicts of block fields, one document."""
    schema = "doc_id int, block_seq int, " + ", ".join(f"{c} {t}" for c, t in BLOCK_FIELDS.items())
    return spark.createDataFrame([(doc, i, *(r.get(c) for c in BLOCK_FIELDS)) for i, r in enumerate(rows)], schema)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


PAGE = [100.0, 100.0]
ROWS = [
    {"type": "text", "text": "Pumps", "text_level": 1, "page_idx": 0},
    {"type": "image", "img_path": "a.png", "img_caption": ["A pump"], "bbox": [0.0, 0.0, 50.0, 50.0], "page_size": PAGE, "page_idx": 0},
    {"type": "text", "text": " ", "page_idx": 0},
    {"type": "table", "table_caption": ["Power"], "table_body": "<td>7</td>", "page_idx": 0},
    {"type": "list", "list_items": ["oil", "wax"], "page_idx": 1},
    {"type": "image", "img_path": "b.png", "bbox": [0.0, 0.0, 3.0, 3.0], "page_size": PAGE, "page_idx": 1},
    {"type": "image", "img_path": "a.png", "img_caption": ["A pump"], "bbox": [0.0, 0.0, 50.0, 50.0], "page_size": PAGE, "page_idx": 1},
    {"type": "footer", "text": "end", "page_idx": 1},
]
FILES = [(1, "a.png", "aa", 400, 300, 50_000), (1, "b.png", "bb", 400, 300, 50_000)]


def files_of(spark, rows=FILES):
    return spark.createDataFrame(rows, "doc_id int, img_path string, sha256 string, width int, height int, size long")


def test_figure_jobs(spark):
    got = {r.block_seq: r for r in figures.image_jobs(blocks_of(spark, ROWS), files_of(spark)).collect()}
    assert set(got) == {1, 6}  # b.png covers too little of its page
    assert got[1].prompt == "Image caption (Page 1): A pump\nContext before: [Page 1] [ChunkType=Title] Pumps\nContext after: [Page 1] [ChunkType=Body] Power\n<td>7</td>\n[Page 2] [ChunkType=Body] oil\nwax"
    assert got[6].prompt == "Image caption (Page 2): A pump\nContext before: [Page 1] [ChunkType=Body] Power\n<td>7</td>\n[Page 2] [ChunkType=Body] oil\nwax"
    assert (got[1].image_seq, got[6].image_seq, got[1].base_text) == (1, 2, "A pump")
    bare = "Image caption: A pump\nContext before: [ChunkType=Body] Power\n<td>7</td>\n[ChunkType=Body] oil\nwax"
    assert got[6].key == hashlib.sha256(f"2\0aa\0{bare}".encode()).hexdigest()
    with pytest.raises(Exception, match="Missing image asset: b.png"):
        figures.image_jobs(blocks_of(spark, ROWS), files_of(spark, FILES[:1])).collect()


def test_equal_requests_are_asked_once(spark):

    @providers.register("count")
    def count(texts):
        return texts.map(lambda t: f"seen {len(t)}")

    rows = [dict(ROWS[1], page_idx=i) for i in range(6)]
    jobs = figures.image_jobs(blocks_of(spark, rows), files_of(spark))
    # without positions the two in the middle see the same neighbours
    assert [r.image_seq for r in jobs.orderBy("block_seq").collect()] == [1, 2, 3, 3, 4, 5]
    told = providers.describe(jobs, providers=["count"]).orderBy("block_seq").collect()
    assert len(told) == 6 and told[2].vision_text == told[3].vision_text
    chunks = providers.parse_with_images(blocks_of(spark, ROWS), files_of(spark), providers=["count"], chunk_type=True).orderBy("block_seq").collect()
    assert [(r.block_seq, r.type) for r in chunks] == [(0, "title"), (1, "image"), (3, None), (4, None), (6, "image"), (7, "footer")]
    assert chunks[1].text.startswith("A pump\nseen ")


def test_providers_that_fail_or_answer_badly(spark):
    @providers.register("raises")
    def raises(texts):
        raise RuntimeError("down")

    @providers.register("blank")
    def blank(texts):
        return texts.map(lambda t: "  ")

    @providers.register("short")
    def short(texts):
        return texts.map(lambda t: "no" if t == "b" else "a good answer")

    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    got = {r.prompt: r.vision_text for r in providers.answers(df, providers=["raises", "blank", "short"], valid=lambda s: s.str.len() > 3).collect()}
    assert got == {"a": "a good answer", "b": providers.UNRECOGNISED}


def test_measures(spark):
    rows = [{"type": "image", "bbox": [0.0, 0.0, 20.0, 5.0], "page_size": PAGE}, {"type": "image", "bbox": [5.0, 5.0, 1.0, 9.0], "page_size": PAGE}, {"type": "image", "bbox": [1.0], "page_size": PAGE}, {"type": "image"}]
    got = [(r.area_ratio, r.box_aspect) for r in figures.measures(blocks_of(spark, rows)).orderBy("block_seq").collect()]
    assert got == [(0.01, 4.0), (0.0, None), (None, None), (None, None)]


@pytest.mark.parametrize("window", [1, 2, 3])
def test_context_of_any_window(spark, window):
    rows = [(1, i, t) for i, t in enumerate(["a", "", "b", "c", None, " ", "d", "e", "f"])]
    df = spark.createDataFrame(rows, "g int, o int, line string")
    got = {r.o: (r.before, r.after) for r in context.context(df, group="g", order="o", line="line", at=F.lit(True), window=window).collect()}
    for i in range(len(rows)):
        full = [(o, t) for _, o, t in rows if t and t.strip()]
        assert got[i] == ("\n".join(t for o, t in full if o < i).split("\n")[-window:] and "\n".join([t for o, t in full if o < i][-window:]), "\n".join([t for o, t in full if o > i][:window]))


def test_numbers_of_first_use(spark):
    rows = [(g, (i * 37) % 1001, f"k{(i * i) % 50}") for g in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "d int, o int, key string").dropDuplicates(["d", "o"])
    for slices in (None, 1, 7, 1024):
        got = figures.first_seen_numbers(df, group="d", order="o", key="key", slices=slices).collect()
        for g in (1, 2):
            seen: dict = {}
            for r in sorted((r for r in got if r.d == g), key=lambda r: r.o):
                assert r.image_seq == seen.setdefault(r.key, len(seen) + 1)


def test_prompts(spark):
    none = F.lit(None).cast("string")
    assert value(spark, prompts.vision_prompt(F.lit("near"), F.lit(" "), "Rules.")) == "Reference context:\nnear\n\nExtraction instructions:\nRules."
    assert value(spark, prompts.vision_prompt(none, F.lit(" Say it "), "Rules.")) == "Say it"
    assert value(spark, prompts.strict_prompt(F.lit("In French"), "Rules.")) == f"Rules.\n\n{prompts.OVERRIDE}\nIn French"
    assert value(spark, prompts.strict_prompt(none, "Rules.")) == "Rules."
    plain = value(spark, prompts.messages(F.lit("near"), none, F.lit("u"), "Rules."))
    assert [(m.role, m.image_url) for m in plain] == [("system", None), ("user", "u")] and plain[1].text.endswith("near")
    own = value(spark, prompts.messages(F.lit("near"), F.lit("Say it"), F.lit("u"), "Rules."))
    assert len(own) == 1 and own[0].text.startswith("Say it\n\n") and own[0].text.endswith("\nnear")


def test_page_ranges_as_text(spark):
    assert [project.range_text(*x) for x in ((0, None), (2, None), (0, 0), (3, 8))] == ["all", "3-r1", "1-1", "4-9"]
    b = blocks_of(spark, [{"type": "text", "text": "x", "page_idx": i} for i in range(5)])
    for spec, want in (("all", [0, 1, 2, 3, 4]), ("3-r1", [2, 3, 4]), ("1-1", [0]), ("2-r2", [1, 2, 3]), ("4-9", [3, 4])):
        assert [r.page_idx for r in project.pages_of(b, spec).orderBy("page_idx").collect()] == want
    for bad in ((-1, None), (True, None), (3, 2)):
        with pytest.raises(ValueError):
            project.range_text(*bad)


def test_articles(spark):
    rows = [{"type": "equation", "text": "a", "text_level": 1}, {"type": "header", "text": "h"}, {"type": "text", "text": " "}, {"type": "image", "img_footnote": ["n"], "img_caption": ["c"]}, {"type": "table", "table_footnote": ["t"]}, {"type": "list", "text": "l"}, {"type": "image", "img_path": "x"}]
    got = [(r.block_seq, r.text, r.type) for r in project.project_articles(blocks_of(spark, rows)).orderBy("block_seq").collect()]
    assert got == [(0, "a", "title"), (3, "c\nn", None), (4, "t", None), (5, "l", None)]


def test_assets(spark):
    b = blocks_of(spark, ROWS)
    assert project.checked_assets(b, files_of(spark)).count() == len(ROWS)
    with pytest.raises(Exception, match="Missing image asset"):
        project.checked_assets(b, files_of(spark, [])).collect()


def test_markdown_helpers(spark):
    given = "\n#  Pumps  \ntext \n\n\n\nmore\n## Next\n| a |\n: Power\n| b |\n"
    assert value(spark, render.tidy_markdown(F.lit(given))) == "# Pumps\n\ntext\n\nmore\n\n## Next\n\n| a |\n\n: Power\n\n| b |\n"
    df = spark.createDataFrame([(t,) for t in ("\\newpage", "a \\newpage", "\f", "<!-- PageBreak -->", '<div class="x pagebreak"></div>', "::: pagebreak", "text")], "t string")
    assert [r.b for r in df.select(render.is_page_break(F.col("t")).alias("b")).collect()] == [True, False, True, True, True, True, False]


def test_label_numbers_and_references(spark):
    labels = spark.createDataFrame([(1, 5, "fig:b"), (1, 2, "fig:a"), (1, 9, "fig:a"), (1, 3, "tbl:x"), (2, 1, "fig:b"), (1, 4, "eq:y")], "doc_id int, position int, label string")
    numbers = render.label_numbers(labels)
    assert {(r.doc_id, r.label): r.number for r in numbers.collect()} == {(1, "fig:a"): 1, (1, "fig:b"): 2, (1, "tbl:x"): 1, (1, "eq:y"): 1, (2, "fig:b"): 1}
    texts = spark.createDataFrame([(1, "see [@fig:b], [@tbl:x] and [@eq:y] [@fig:none]"), (3, "[@fig:a]"), (1, "plain")], "doc_id int, text string")
    got = sorted(r.text for r in render.with_references(texts, numbers).collect())
    assert got == sorted(["see 图2, 表1 and [@eq:y] [@fig:none]", "[@fig:a]", "plain"])


def test_content_lists_both_ways(spark):
    b = blocks_of(spark, [{"type": "text", "text": "one \"x\""}, {"type": "list", "list_items": ["a", "b"], "page_idx": 2}])
    body = render.content_list(b).first().body
    assert json.loads(body) == [{"type": "text", "text": 'one "x"'}, {"type": "list", "list_items": ["a", "b"], "page_idx": 2}]
    back = content_blocks(spark.createDataFrame([(1, body)], "doc_id int, body string")).orderBy("block_seq").collect()
    assert [(r.type, r.text, r.list_items) for r in back] == [("text", 'one "x"', None), ("list", None, ["a", "b"])]
    deep = content_blocks(spark.createDataFrame([(1, '[{"list_items": ["a", ["b", ["c", " "]], 4]}]')], "doc_id int, body string")).first()
    assert deep.list_items == ["a", "b", "c", "4"]


def test_identity(spark):
    settings = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit('"x"'))
    assert value(spark, identity.canonical_json(settings)) == json.dumps({"a": "x", "b": 2}, sort_keys=True)
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert value(spark, identity.job_id(space, F.lit("parse"), F.lit("k-é"))) == str(uuid.uuid5(uuid.UUID(space), "parse\0k-é"))
    same = [value(spark, identity.endpoint_key(F.lit(u))) for u in ("HTTP://Host:80/v1/", " http://host/v1", "http://host/v1#x")]
    assert len(set(same)) == 1 and value(spark, identity.endpoint_key(F.lit("http://host/V1"))) != same[0]


def test_reports(spark):
    got = value(spark, metrics.pattern_faults(F.lit("Load 7 kW"), required=["kw", "speed"], forbidden=["load", "draft"]))
    assert (got.missing, got.forbidden, got.ok) == (["speed"], ["load"], False)
    assert value(spark, metrics.pattern_faults(F.lit("a"), required=[], forbidden=[])).ok is True
    rows = spark.createDataFrame([("x", True, 5), ("x", None, None), ("y", False, 2)], "endpoint string, ok boolean, completion_tokens int")
    assert {tuple(r) for r in metrics.endpoint_report(rows).collect()} == {("x", 2, 1, 5), ("y", 1, 0, 2)}
    pages = spark.createDataFrame([(1, "a b" * 11), (1, "　\n"), (2, "short"), (3, None)], "doc_id int, text string")
    assert {tuple(r) for r in metrics.has_text_layer(pages, least=20).collect()} == {(1, 22, True), (2, 5, False), (3, 0, False)}
