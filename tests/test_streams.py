"""Streams against the batch operators, over micro-batches, restarts and failures."""

import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafwise.operators import ledger
from leafwise.streaming import ledger as streams

START = datetime(2024, 1, 1)


def land(spark, rows, schema, path):
    """One more file for a stream to find."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120), "the stream does not end with its source"
    return q


def rounds(spark, tmp_path, parts, schema, make):
    """The output of a stream that is stopped and started again between the parts."""
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for rows in parts:
        land(spark, rows, schema, path)
        drain(make(spark.readStream.schema(schema).parquet(path)), out, cp)
    return spark.read.parquet(out)


def cut(rows, n):
    return [rows[len(rows) * i // n : len(rows) * (i + 1) // n] for i in range(n)]


def test_fence_equals_batch_over_restarts(spark, tmp_path):
    rnd = random.Random(1)
    schema = "job_id string, generation long, state string, seq long"
    rows = [(f"j{rnd.randrange(9)}", rnd.randrange(5), "x", i) for i in range(200)]
    got = rounds(spark, tmp_path, cut(rows, 3), schema, streams.fenced)
    want = ledger.fence(spark.createDataFrame(rows, schema), order="seq")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_fence_forgets_by_event_time(spark, tmp_path):
    schema = "job_id string, generation long, seq long, ts timestamp"
    at = lambda h: START + timedelta(hours=h)
    parts = [[("a", 5, 0, at(0)), ("b", 1, 1, at(0))], [("b", 1, 2, at(30))], [("b", 1, 3, at(31))], [("a", 1, 4, at(40)), ("b", 0, 5, at(41))]]
    make = lambda s: streams.fenced(s, ts="ts", retention_s=3600 * 10, watermark="1 hour")
    got = rounds(spark, tmp_path, parts, schema, make)
    # a's generation 5 is forgotten after ten hours, b's is held by its later messages
    assert sorted(r.seq for r in got.collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="ts"):
        streams.fenced(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), retention_s=5)


def test_created_equals_batch_and_tells_conflicts(spark, tmp_path):
    rnd = random.Random(2)
    schema = "key string, fingerprint string, ts long, body string"
    rows = [(f"k{rnd.randrange(12)}", rnd.choice(["f", "g", "g", None]), i, f"b{i}") for i in range(150)]
    got = rounds(spark, tmp_path, cut(rows, 2), schema, streams.created)
    want = ledger.create_once(spark.createDataFrame(rows, schema)).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.outcome for r in got.collect()} == {"created", "same", "conflict"}
    assert got.filter("outcome = 'created'").count() == got.select("key").distinct().count()


STATES = ["PENDING", "STARTED", "SUCCESS", "FAILURE", "EXPIRED"]


def test_moves_equal_batch_with_two_outputs(spark, tmp_path):
    rnd = random.Random(3)
    schema = "job_id long, seq long, state string"
    rows = [(rnd.randrange(15), i, rnd.choice(STATES)) for i in range(300)]
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in cut(rows, 3):
        land(spark, part, schema, path)
        q = streams.write_split(streams.moved(spark.readStream.schema(schema).parquet(path)), out, {"applied": "applied", "rejected": "NOT applied"}, checkpoint=cp)
        assert q.awaitTermination(120)
    good, bad = spark.read.parquet(f"{out}/applied"), spark.read.parquet(f"{out}/rejected")
    want = ledger.apply_moves(spark.createDataFrame(rows, schema), order=["seq"])
    counted = want.agg(F.sum("n_applied"), F.sum("n_rejected")).first()
    assert (good.count(), bad.count()) == tuple(counted) and bad.count() > 0
    last = good.groupBy("job_id").agg(F.max_by("state", "seq").alias("state"))
    assert sorted(map(tuple, last.collect())) == sorted((r.job_id, r.state) for r in want.collect() if r.state)


def test_tombstones_after_retention(spark, tmp_path):
    schema = "job_id string, seq long, state string, ts timestamp"
    at = lambda h: START + timedelta(hours=h)
    parts = [
        [("done", 0, "PENDING", at(0)), ("done", 1, "SUCCESS", at(1)), ("open", 2, "PENDING", at(1)), ("back", 3, "PENDING", at(1)), ("back", 4, "FAILURE", at(2))],
        [("back", 5, "PENDING", at(5)), ("clock", 6, "PENDING", at(20))],
        [("done", 7, "PENDING", at(21)), ("clock", 8, "STARTED", at(22))],
        [("clock", 9, "STARTED", at(44))],
        [("done", 10, "PENDING", at(45)), ("clock", 11, "SUCCESS", at(46))],
    ]
    make = lambda s: streams.moved(s, ts="ts", retention_s=3600 * 10, watermark="1 hour")
    got = rounds(spark, tmp_path, parts, schema, make).collect()
    stones = [(r.job_id, r.before, r.ts.hour) for r in got if r.seq is None]
    assert stones == [("done", "SUCCESS", 11)]  # `open` is not final, `back` went on
    by = {r.seq: (r.before, r.applied) for r in got if r.seq is not None}
    assert by[7] == ("EXPIRED", False)  # a tombstone takes no more messages
    assert by[10] == (None, True)  # and is forgotten after another retention


def outbox_rows(n, first=0):
    return [(f"j{i}", i % 3, f"body {i}") for i in range(first, first + n)]


@pytest.mark.parametrize("dies", ["before sending", "while sending", "before the receipt"])
def test_outbox_is_sent_once_over_a_crash(spark, tmp_path, dies):
    schema = "job_id string, generation long, body string"
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    left = {"deaths": 1}

    def send(rows, ident):
        if dies == "before sending" and left["deaths"]:
            left["deaths"] = 0
            raise RuntimeError("killed")
        (rows.limit(2) if dies == "while sending" and left["deaths"] else rows).write.mode("overwrite").parquet(f"{out}/sent/id={ident}")
        if left["deaths"]:
            left["deaths"] = 0
            raise RuntimeError("killed")

    tables = {k: spark.createDataFrame([], schema) for k in ("claims", "receipts")}

    def states():
        read = {k: spark.read.schema(schema).parquet(f"{out}/{k}") if (tmp_path / "out" / k).exists() else v for k, v in tables.items()}
        return {(r.job_id, r.generation): r.handoff for r in ledger.handoff(spark.read.parquet(path), read["claims"], read["receipts"]).collect()}

    land(spark, outbox_rows(20), schema, path)
    assert set(states().values()) == {"pending"}
    stream = lambda: spark.readStream.schema(schema).parquet(path)
    q = streams.publish(stream(), out, send, checkpoint=cp)
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination(120)
    assert set(states().values()) == {"uncertain"}
    assert streams.publish(stream(), out, send, checkpoint=cp).awaitTermination(120)
    assert set(states().values()) == {"published"}
    land(spark, outbox_rows(5, 20), schema, path)
    assert sorted(states().values()) == ["pending"] * 5 + ["published"] * 20
    assert streams.publish(stream(), out, send, checkpoint=cp).awaitTermination(120)
    sent = [(r.job_id, r.generation, r.body) for r in spark.read.parquet(f"{out}/sent").collect()]
    assert sorted(sent) == sorted(outbox_rows(25)) and set(states().values()) == {"published"}


def test_outbox_recovery_without_the_checkpoint(spark, tmp_path):
    """What no receipt names, and is its job's newest generation, is what a recovery sends."""
    schema = "job_id string, generation long"
    box = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], schema)
    claims, receipts = spark.createDataFrame([("a", 1), ("b", 1)], schema), spark.createDataFrame([("a", 1)], schema)
    assert {(r.job_id, r.generation): r.handoff for r in ledger.handoff(box, claims, receipts).collect()} == {("a", 1): "published", ("a", 2): "pending", ("b", 1): "uncertain", ("c", 1): "pending"}
    assert sorted(map(tuple, ledger.unpublished(box, receipts).select("job_id", "generation").collect())) == [("a", 2), ("b", 1), ("c", 1)]
    shutil.rmtree(tmp_path, ignore_errors=True)
