"""The job ledger: moves, recovery, checkpoints, profiles, progress; results and their markers; scans."""

import hashlib

import pytest
from pyspark.sql import functions as F

from leafwise.functions import text as T
from leafwise.operators import ledger
from leafwise.sources import files


def test_illegal_moves_are_passed_over(spark):
    rows = [("a", 1, "PENDING"), ("a", 2, "STARTED"), ("a", 3, "PENDING"), ("a", 4, "SUCCESS"), ("a", 5, "FAILURE"), ("a", 6, "EXPIRED"), ("b", 1, "STARTED"), ("c", 1, "PENDING"), ("c", 2, "FAILURE"), ("c", 3, "PENDING"), ("d", 1, None)]
    got = {r.job_id: (r.state, r.n_applied, r.n_rejected) for r in ledger.apply_moves(spark.createDataFrame(rows, "job_id string, ts int, state string"), order=["ts"]).collect()}
    assert got == {"a": ("EXPIRED", 4, 2), "b": (None, 0, 1), "c": ("PENDING", 3, 0), "d": (None, 0, 1)}


def test_recovery(spark):
    outbox = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 3)], "job_id string, generation int")
    receipts = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1)], "job_id string, generation int")
    assert {(r.job_id, r.generation) for r in ledger.unpublished(outbox, receipts).collect()} == {("a", 2), ("c", 3)}


def test_checkpoints(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    manifest = spark.createDataFrame([("ok", 1, "a.json", sha("A")), ("ok", 1, "b.json", sha("B")), ("old", 2, "a.json", sha("A")), ("gone", 1, "x", sha("X")), ("bad", 1, "a.json", sha("A")), ("out", 1, "../x", sha("X"))], "job_id string, version int, path string, sha256 string")
    parts = spark.createDataFrame([("ok", "a.json", "A"), ("ok", "b.json", "B"), ("old", "a.json", "A"), ("bad", "a.json", "?"), ("out", "../x", "X")], "job_id string, path string, content string")
    assert {r.job_id: r.fault for r in ledger.checked_parts(manifest, parts).collect()} == {"ok": None, "old": "version", "gone": "missing", "bad": "content", "out": "path"}


def test_profiles(spark):
    of = lambda v, m: F.create_map(F.lit("version"), F.lit(v), F.lit("model"), F.lit(m))
    got = spark.range(1).select(
        ledger.profile_fits(ledger.profile_sha(of("2", '"x"')), of("2", '"x"'), images=F.lit(False)).alias("same"),
        ledger.profile_fits(ledger.profile_sha(of("1", '"x"')), of("2", '"x"'), images=F.lit(True)).alias("older"),
        ledger.profile_fits(ledger.profile_sha(of("1", '"x"')), of("2", '"x"'), images=F.lit(False)).alias("parse"),
        ledger.profile_fits(ledger.profile_sha(of("2", '"x"')), of("2", '"y"'), images=F.lit(True)).alias("other"),
    )
    assert tuple(got.first()) == (True, True, False, False)


def test_progress_routes_and_kinds(spark):
    asked = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc_id int, image_seq int")
    done = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "doc_id int, image_seq int")
    assert {tuple(r) for r in ledger.progress(asked, done, ["doc_id", "image_seq"]).collect()} == {(1, 2, 1, "vision"), (2, 1, 1, "merge")}
    df = spark.createDataFrame([("urgent", "parse"), ("normal", "merge"), ("normal", "none")], "p string, s string")
    assert [r.q for r in df.select(ledger.route(F.col("p"), F.col("s"), {"parse": "q.parse", "merge": "q.merge"}).alias("q")).collect()] == ["q.parse_urgent", "q.merge", None]
    lists = spark.createDataFrame([(["b", "a"], ["c", "b"], ["X", None, "Y", "X"])], "x array<string>, y array<string>, k array<string>")
    assert tuple(lists.select(ledger.queue_union(F.col("x"), F.col("y")).alias("u"), ledger.failure_kinds(F.col("k"), 2).alias("k")).first()) == (["b", "a", "c"], ["X", "Y"])


def test_results_are_marked_once(spark, tmp_path):
    path = str(tmp_path / "r")
    for rows in ([("a", "1")], [("b", "2"), ("c", "3")], [("a", "1")]):
        files.write_results(spark.createDataFrame(rows, "job_id string, body string"), path)
    assert sorted(map(tuple, files.read_results(spark, path).collect())) == [("a", "1"), ("b", "2"), ("c", "3")]
    spark.createDataFrame([("d", "half")], "job_id string, body string").write.parquet(f"{path}/results/part=x")
    assert files.read_results(spark, path).count() == 3


def test_scans(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path))
    for name in ("z.pdf", "a.PNG", "note.md"):
        (tmp_path / name).write_bytes(name.encode())
    found = files.scan(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["a.PNG", "z.pdf"]
    assert files.to_enqueue(found).count() == 4
    (tmp_path / "m.json").write_text('{"a": {"b": 7}}')
    last = files.scan(spark, str(tmp_path), formats=["json"])
    assert files.newest_field(last, "$.a.b").first().value == "7" and files.newest(last).first().path.endswith("m.json")


def test_character_references(spark):
    df = spark.createDataFrame([("&#8212;&#x1F642;&lt;b&gt; &amp;lt; &#0; &#xD800; &unknown; &times;",), (None,)], "c string")
    assert [r.t for r in df.select(T.unescape("c").alias("t")).collect()] == ["—🙂<b> &lt; &#0; &#xD800; &unknown; ×", None]
