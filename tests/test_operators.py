"""Context, figures, checkbox repair, ledger, metrics, sources and streams."""

import hashlib

import pytest
from pyspark.sql import functions as F

from leafwise.operators import context, figures, ledger, metrics, providers
from leafwise.sources import files
from leafwise.streaming import ledger as streams


def test_context_window(spark):
    rows = [(1, i, t) for i, t in enumerate(["a", "", "b", "c", None, "d", "e"])]
    df = spark.createDataFrame(rows, "g int, o int, line string")
    got = {r.o: (r.before, r.after) for r in context.context(df, group="g", order="o", line="line", at=F.lit(True)).collect()}
    for i in range(len(rows)):
        before = [t for _, o, t in rows if o < i and t][-2:]
        after = [t for _, o, t in rows if o > i and t][:2]
        assert got[i] == ("\n".join(before), "\n".join(after))


def test_prompt(spark):
    df = spark.range(1).select(context.context_line(F.lit("Load [Page 4]"), F.lit(0), F.lit(False)).alias("b"), context.context_line(F.lit("Speed"), F.lit(0), F.lit(False), positions=False).alias("a"))
    out = df.select(context.prompt(F.lit("Fig. of a pump"), F.lit(" "), F.col("b"), F.col("a"), F.lit(0)).alias("p")).first().p
    assert out == "Image caption (Page 1): Fig. of a pump\nContext before: [Page 1] [ChunkType=Body] Load [Page 4]\nContext after: [ChunkType=Body] Speed"


def test_request_keys_and_numbers(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "x"), (1, 3, None), (2, 0, "y")], "d int, o int, c string")
    keyed = df.withColumn("key", figures.request_key(F.lit("h"), F.col("c")))
    rows = figures.first_seen_numbers(keyed, group="d", order="o", key="key").orderBy("d", "o").collect()
    assert [r.image_seq for r in rows] == [1, 2, 1, 3, 1]
    assert rows[0].key == hashlib.sha256(b"2\0h\0x").hexdigest()


def test_skip_reasons(spark):
    cases = [((0.02, 1, 300, 300, 20000, False), None), ((0.006, 1, 300, 300, 20000, False), "area"), ((0.006, 1, 20, 20, 5, True), None), ((None, None, None, None, None, False), None), ((0.02, 11, 300, 300, 20000, False), "box_aspect"), ((0.02, 1, 3300, 300, 20000, False), "aspect"), ((0.02, 1, 90, 300, 20000, False), "side"), ((0.02, 1, 300, 300, 2000, False), "bytes")]
    df = spark.createDataFrame([(i, *[float(x) if k < 2 and x is not None else x for k, x in enumerate(c)]) for i, (c, _) in enumerate(cases)], "i int, a double, b double, w int, h int, s int, c boolean")
    got = df.select("i", figures.skip_reason(area_ratio=F.col("a"), box_aspect=F.col("b"), width=F.col("w"), height=F.col("h"), size=F.col("s"), captioned=F.col("c")).alias("r"))
    assert [r.r for r in got.orderBy("i").collect()] == [w for _, w in cases]


def test_ledger(spark):
    m = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, "x"), ("a", 3, 1, "y"), ("b", 1, 5, "z")], "job_id string, ts int, generation int, state string")
    assert {(r.job_id, r.ts) for r in ledger.fence(m).collect()} == {("a", 1), ("a", 2), ("b", 1)}
    made = ledger.create_once(m.select(F.col("job_id").alias("key"), "ts", F.col("state").alias("fingerprint")))
    assert [r.outcome for r in made.orderBy("key", "ts").collect()] == ["created", "same", "conflict", "created"]
    keys = spark.createDataFrame([("ok-1",), ("",), ("a b",), ("x" * 201,)], "k string")
    assert [r.v for r in keys.select(ledger.valid_key("k").alias("v")).collect()] == [True, False, False, False]
    old = spark.createDataFrame([("a", "SUCCESS", 0), ("b", "STARTED", 0), ("c", "FAILURE", 95)], "job_id string, state string, t int").withColumns({"updated_at": F.timestamp_seconds("t"), "completed_at": F.lit(None).cast("timestamp")})
    gone = ledger.collectable(old, now=F.timestamp_seconds(F.lit(100)), retention_s=50)
    assert [r.job_id for r in gone.collect()] == ["a"]
    assert {(r.job_id, r.state) for r in ledger.expire(old, gone).collect()} == {("a", "EXPIRED"), ("b", "STARTED"), ("c", "FAILURE")}


def test_percentiles(spark):
    df = spark.range(10).select(F.lit(1).alias("g"), F.col("id").alias("v"))
    assert df.agg(metrics.nearest_rank("v", 0.95).alias("p")).first().p == 9
    assert metrics.floor_index(df, group="g", value="v", p=0.95, name="p").first().p == 8


def test_request_plan_and_pages(spark):
    c, e = spark.range(3).select(F.col("id").alias("case")), spark.createDataFrame([("x",), ("y",)], "endpoint string")
    plan = metrics.request_plan(c, e, repetitions=2, seed=1)
    assert plan.select("case", "endpoint", "repetition").distinct().count() == plan.count() == 12
    pages = metrics.case_pages(spark.createDataFrame([(0, 2), (1, 1)], "source_index int, n_pages int"), pages=5, cycles=3)
    assert [(r.source_index, r.source_page) for r in pages.orderBy("position").collect()] == [(0, 0), (0, 1), (1, 0), (0, 0), (0, 1)]


def test_providers(spark):
    @providers.register("down")
    def down(prompts):
        return prompts.map(lambda p: None)

    df = spark.createDataFrame([("ab",), ("c",)], "prompt string")
    assert [r.vision_text for r in providers.answers(df, providers=["down", "stub"]).collect()] == ["Figure of 2 letters", "Figure of 1 letters"]


def test_files_and_words(spark, tmp_path):
    for name in ("a.PDF", "b.txt", "c.docx"):
        (tmp_path / name).write_bytes(name.encode())
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.scan(spark, str(tmp_path)).select("path").collect()) == ["a.PDF", "c.docx"]
    xml = '<!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml"><body><doc><page width="1" height="2"><word xMin="1.5" yMin="2" xMax="3" yMax="4">hi</word></page><page></page></doc></body></html>'
    got = files.words(spark.createDataFrame([(7, xml)], "doc_id int, xml string")).collect()
    assert [(r.doc_id, r.page_idx, r.x_min, r.y_min, r.text) for r in got] == [(7, 0, 1.5, 2.0, "hi")]


def test_stream_fence(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "job_id string, generation long, state string, seq long"
    spark.createDataFrame([("a", 1, "x", 1), ("a", 2, "y", 2), ("a", 1, "late", 3), ("b", 1, "z", 4)], schema).coalesce(1).write.parquet(path)
    stream = streams.fenced(spark.readStream.schema(schema).parquet(path))
    q = stream.writeStream.format("memory").queryName("fenced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r.job_id, r.seq) for r in spark.table("fenced").collect()} == {("a", 1), ("a", 2), ("b", 4)}


@pytest.mark.parametrize("name", ["plain_text_per_page", "generation_fence"])
def test_queries_run(spark, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
