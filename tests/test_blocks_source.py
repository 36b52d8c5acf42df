"""The data source of parsed documents: pushed conditions, slices, three kinds of files."""

import json

import pytest
from pyspark.sql import functions as F

from leafwise.sources import blocks as source
from leafwise.sources.html import page_blocks


def lines(path, pages):
    path.write_text("".join(json.dumps({"doc_id": d, "tier": t, "page_idx": p, "blocks": b}, separators=(",", ":")) + "\n" for d, t, p, b in pages))


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_pages_outside_are_never_parsed(spark, tmp_path):
    file = tmp_path / "p.jsonl"
    lines(file, [("a", "basic", p, [{"block_seq": p, "type": "text", "text": f"a{p}"}]) for p in range(5)])
    with file.open("a") as f:
        f.write('{"doc_id":"b","tier":"basic","page_idx":9,"blocks":[{"type": broken\n')
        f.write('{"doc_id":"c \\" d","tier":"high","page_idx":1,"blocks":[{"block_seq":0,"type":"text","text":"c"}]}\n')
    read = lambda where=None: source.read_blocks(spark, str(tmp_path), where=where)
    some = read("page_idx BETWEEN 1 AND 3 AND tier = 'basic'")
    assert sorted(r.text for r in some.collect()) == ["a1", "a2", "a3"]
    pushed = plan(some).split("PushedFilters: [")[1].split("]")[0]
    assert {"GreaterThanOrEqual(page_idx,1)", "LessThanOrEqual(page_idx,3)", "EqualTo(tier,basic)"} <= set(pushed.split(", "))
    assert "Filter (" not in plan(some), "the scan has taken the conditions over"
    assert [r.doc_id for r in read("tier = 'high' AND page_idx < 9").collect()] == ['c " d']
    assert sorted(r.text for r in read(F.col("page_idx").isin(0, 4) & (F.length("text") == 2)).collect()) == ["a0", "a4"]
    with pytest.raises(Exception, match="no JSON at byte"):
        read().collect()


def test_conditions_of_one_plan_do_not_reach_another(spark, tmp_path):
    lines(tmp_path / "p.jsonl", [("a", "basic", p, [{"type": "text", "text": "x"}]) for p in range(6)])
    df = source.read_blocks(spark, str(tmp_path), where="page_idx > 0")
    pages = lambda rows: sorted(r.page_idx for r in rows.collect())
    three, low = df.filter("page_idx = 3"), df.filter("page_idx < 3")
    three._jdf.queryExecution().executedPlan()
    assert pages(low) == [1, 2] and pages(three) == [3] and pages(df) == [1, 2, 3, 4, 5]
    assert pages(three.unionByName(low)) == [1, 2, 3]
    assert pages(source.read_blocks(spark, str(tmp_path))) == [0, 1, 2, 3, 4, 5]


def test_slices_hold_each_line_once(spark, tmp_path):
    pages = [(f"d{i}", None, i % 7, [{"block_seq": k, "type": "text", "text": "x" * (i % 40)} for k in range(i % 4)]) for i in range(300)]
    lines(tmp_path / "one.jsonl", pages)
    want = sorted((d, p, k) for d, _, p, b in pages for k in range(len(b)))
    for size in (1, 13, 200, 10**6):
        df = source.read_blocks(spark, str(tmp_path), sliceBytes=str(max(size, 97)))
        assert sorted((r.doc_id, r.page_idx, r.block_seq) for r in df.collect()) == want
    reader = source.BlockReader({"path": str(tmp_path), "sliceBytes": "13"})
    assert sorted((r["doc_id"], r["page_idx"], r["block_seq"]) for part in reader.partitions() for r in reader.rows(part)) == want


def test_content_lists_keep_presence_and_the_last_path_wins(spark, tmp_path):
    for folder, text in (("first", "old"), ("second", "new")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "doc_content_list.json").write_text(json.dumps([
            {"type": "text", "text": text, "text_level": 1, "page_idx": 0},
            {"type": "image", "img_path": "i.png", "image_caption": [], "img_caption": ["a", ["b", [None, " "]], 7], "chart_caption": None, "page_idx": 1, "bbox": [1, 2.5, 3, 4]},
            {"type": "text", "text": "lone \ud800 mark"},
        ]))
    (tmp_path / "first" / "other.json").write_text("[]")
    (tmp_path / "first" / "more.json").write_text('[{"type": "text", "text": "more", "page_idx": 0}]')
    both = [str(tmp_path / n) for n in ("first", "second")]
    rows = source.read_blocks(spark, *both, tier="basic").orderBy("block_seq").collect()
    assert [r.text for r in rows] == ["new", None, "lone  mark"] and {r.doc_id for r in rows} == {"doc"}
    assert (rows[1].img_caption, rows[1].image_caption, rows[1].chart_caption, rows[1].table_caption, rows[1].bbox) == (["a", "b", "7"], [], [], None, [1.0, 2.5, 3.0, 4.0])
    assert rows[0].text_level == 1 and rows[2].page_idx is None and rows[0].tier == "basic"
    every = source.read_blocks(spark, *both, keep="all")
    assert sorted(r.text for r in every.filter("page_idx = 0").collect()) == ["more", "new"]
    count = lambda where: source.read_blocks(spark, *both, keep="all", where=where).count()
    assert [count("doc_id = 'more'"), count("tier = 'basic'"), count("page_idx IS NOT NULL"), count("page_idx = 1")] == [1, 0, 3, 1]


def test_page_words(spark, tmp_path):
    word = '<word xMin="1" yMin="{0}" xMax="3" yMax="4">w{0} &amp; x</word>'
    body = "".join(f'<page width="9" height="9">{"".join(word.format(10 * p + k) for k in range(p))}</page>' for p in range(4)) + "<page/>"
    (tmp_path / "w.xml").write_text(f"<html><body><doc>{body}</doc></body></html>")
    df = source.read_blocks(spark, f"file://{tmp_path}/w.xml")
    assert [(r.page_idx, r.block_seq, r.text, r.bbox[1]) for r in source.read_blocks(spark, f"file://{tmp_path}/w.xml", where="page_idx = 2").collect()] == [(2, 1, "w20 & x", 20.0), (2, 2, "w21 & x", 21.0)]
    assert df.count() == 6
    with pytest.raises(Exception, match="no parsed documents"):
        (tmp_path / "none").mkdir()
        source.read_blocks(spark, str(tmp_path / "none")).collect()


def test_written_pages_come_back(spark, tmp_path):
    html = spark.createDataFrame([(1, "<title>T</title><h1>H &lt;</h1>" + "<p>x</p><li>é</li>" * 12), (2, "<p>\"q\"</p>"), (3, None)], "page_id long, html string")
    made = page_blocks(html).withColumn("tier", F.when(F.col("doc_id") == 1, "basic"))
    source.write_pages(made, f"{tmp_path}/pages")
    got = source.read_blocks(spark, f"{tmp_path}/pages")
    cols = ["block_seq", "page_idx", "type", "text", "text_level", "list_items", "tier"]
    assert sorted(map(str, got.select(F.col("doc_id").cast("long"), *cols).collect())) == sorted(map(str, made.select("doc_id", *cols).collect()))
