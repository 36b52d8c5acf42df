"""Scans and model calls that go on where they were."""

import os
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from leafwise.operators import providers
from leafwise.streaming import scan

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors cannot import test modules


def put(folder, names, at):
    folder.mkdir(exist_ok=True)
    for i, name in enumerate(names):
        (folder / name).write_bytes(name.encode())
        os.utime(folder / name, (at + i, at + i))


def test_files_are_seen_once_over_restarts_and_in_order(spark, tmp_path):
    src, out, cp = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "cp")
    put(src, [f"{c}.pdf" for c in "gbfa"] + ["note.txt"] + [f"{c}.PNG" for c in "ec"], 1_700_000_000)
    stream = lambda: scan.files_as_they_come(spark, str(src), files_per_batch=2)
    assert scan.scan_on(stream(), out, checkpoint=cp).awaitTermination(120)
    found = lambda: [(r.batch, r.name) for r in spark.read.parquet(out).select("batch", F.regexp_extract("path", "[^/]+$", 0).alias("name"), "modificationTime").orderBy("modificationTime").collect()]
    assert [n for _, n in found()] == ["g.pdf", "b.pdf", "f.pdf", "a.pdf", "e.PNG", "c.PNG"]
    batches = [b for b, _ in found()]
    assert batches == sorted(batches) and max(map(batches.count, batches)) <= 2
    assert scan.scan_on(stream(), out, checkpoint=cp).awaitTermination(120) and len(found()) == 6
    put(src, ["new.pdf", "newer.pdf", "newest.pdf"], 1_700_000_100)
    assert scan.scan_on(stream(), out, checkpoint=cp).awaitTermination(120)
    assert [n for _, n in found()][6:] == ["new.pdf", "newer.pdf", "newest.pdf"] and len(found()) == 9
    assert spark.read.parquet(out).filter("sha256 = sha2(content, 256)").count() == 9


def test_a_scan_that_fails_goes_on_behind_its_last_whole_batch(spark, tmp_path):
    src, out, cp = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "cp")
    put(src, [f"f{i}.pdf" for i in range(6)], 1_700_000_000)
    fails = F.when(F.col("path").endswith("f3.pdf"), F.raise_error(F.lit("disk full")).cast("string")).otherwise(F.col("sha256"))
    stream = lambda: scan.files_as_they_come(spark, str(src), files_per_batch=2)
    with pytest.raises(Exception, match="disk full"):
        scan.scan_on(stream().withColumn("sha256", fails), out, checkpoint=cp).awaitTermination(120)
    assert spark.read.parquet(f"{out}/batch=0").count() == 2
    assert scan.scan_on(stream(), out, checkpoint=cp).awaitTermination(120)
    assert sorted(r.path[-6:] for r in spark.read.parquet(out).select("path").collect()) == [f"f{i}.pdf" for i in range(6)]


def note(path, line):
    with open(path, "a") as f:
        f.write(line + "\n")


def calls(path):
    return path.read_text().split() if path.exists() else []


def test_answers_survive_a_task_that_is_run_twice(spark, tmp_path):
    log, flag = tmp_path / "calls", tmp_path / "dead"

    @providers.register_client("mortal")
    def mortal():
        note(log, "setup")

        def ask(text):
            note(log, text)
            if text == "p7" and not flag.exists():
                flag.touch()
                os._exit(1)  # the worker dies, as with its executor
            return f"answer to {text}"

        return ask

    asked = spark.createDataFrame([(f"k{i % 20}", f"p{i % 20}") for i in range(60)], "key string, prompt string")
    run = lambda: providers.completions(asked, str(tmp_path / "journal"), providers=["mortal"], concurrent=1, buckets=3)
    with pytest.raises(Exception, match="crashed|Python worker"):
        run().collect()
    got = {r.key: r.answer for r in run().collect()}
    assert got == {f"k{i}": f"answer to p{i}" for i in range(20)}
    asked_for = [c for c in calls(log) if c != "setup"]
    assert sorted(set(asked_for)) == sorted(f"p{i}" for i in range(20))
    assert [c for c in set(asked_for) if asked_for.count(c) > 1] == ["p7"], "only the call under way is made again"
    assert {r.key: r.answer for r in run().collect()} == got and [c for c in calls(log) if c != "setup"] == asked_for


def test_clients_fall_back_and_failures_are_told(spark, tmp_path):
    log = tmp_path / "calls"

    @providers.register_client("broken")
    def broken():
        note(log, "broken")

        def ask(text):
            raise TimeoutError(text)

        return ask

    @providers.register_client("blank")
    def blank():
        return lambda text: "  " if text < "p5" else "no good" if text == "p9" else None

    @providers.register_client("good")
    def good():
        return lambda text: None if text == "p3" else text.upper()

    rows = [(f"k{i}", f"p{i}") for i in range(10)] + [(None, "x"), ("empty", None)]
    asked = spark.createDataFrame(rows, "key string, prompt string")
    run = lambda names: {r.key: r for r in providers.completions(asked, str(tmp_path / "j"), providers=names, buckets=2, valid=lambda a: a != "no good").collect()}
    got = run(["broken", "blank", "good"])
    assert len(got) == 11 and got["k1"].answer == "P1" and got["k1"].provider == "good" and got["k1"].failures == ["TimeoutError", "Unusable"]
    assert got["k3"].answer is None and got["k3"].failures == ["TimeoutError", "Unusable", "Unusable"]
    assert len(calls(log)) <= 4  # once a task, not once a request
    again = run(["good"])
    assert again["k1"].failures == [] and again["k1"].answer == "P1" and again["k3"].answer is None
    assert providers.completions(asked.filter("false"), str(tmp_path / "j"), providers=["good"]).count() == 0


def test_a_cut_off_line_is_asked_again(spark, tmp_path):
    @providers.register_client("plain")
    def plain():
        return lambda text: text + "!"

    asked = spark.createDataFrame([(f"k{i}", "p" * random.Random(i).randint(1, 9)) for i in range(8)], "key string, prompt string")
    run = lambda: sorted((r.key, r.answer) for r in providers.completions(asked, f"file://{tmp_path}/j", providers=["plain"], buckets=1).collect())
    want = run()
    file = next((tmp_path / "j" / "bucket=0").glob("*.jsonl"))
    file.write_bytes(file.read_bytes()[:-9])
    assert run() == want and len(list((tmp_path / "j" / "bucket=0").glob("*.jsonl"))) == 2
