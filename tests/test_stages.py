"""Durable stages: what a second run makes again, and what it does not."""

import glob
import shutil

import pytest
from pyspark.sql import functions as F

from leafwise.operators import stages

SCHEMA = "part int, doc string, text string"
ROWS = [(p, f"d{p}{i}", f"text {p} {i}") for p in range(4) for i in range(3)]


class Counted:
    """A stage function that counts the rows it is asked for, in an accumulator."""

    def __init__(self, spark):
        self.asked = spark.sparkContext.accumulator(0)

    def __call__(self, rows):
        asked = self.asked

        def upper(batches):
            for b in batches:
                asked.add(len(b))
                b["text"] = b["text"].str.upper()
                yield b[b["text"] != "GONE"]

        return rows.mapInPandas(upper, SCHEMA)

    def since(self):
        n, self.asked.value = self.asked.value, 0
        return n


def got(df):
    return sorted((r.part, r.doc, r.text) for r in df.collect())


def want(rows):
    return sorted((p, d, t.upper()) for p, d, t in rows if t != "gone")


@pytest.fixture()
def counted(spark):
    return Counted(spark)


def test_second_run_asks_nothing(spark, tmp_path, counted):
    path, df = str(tmp_path / "s"), spark.createDataFrame(ROWS, SCHEMA)
    assert got(stages.stage(df, counted, path)) == want(ROWS) and counted.since() == len(ROWS)
    assert got(stages.stage(df.orderBy(F.desc("doc")), counted, path)) == want(ROWS) and counted.since() == 0


def test_only_changed_damaged_and_new_parts_are_made(spark, tmp_path, counted):
    path = str(tmp_path / "s")
    stages.stage(spark.createDataFrame(ROWS, SCHEMA), counted, path)
    counted.since()
    changed = [(p, d, t if d != "d10" else "new text") for p, d, t in ROWS]
    assert got(stages.stage(spark.createDataFrame(changed, SCHEMA), counted, path)) == want(changed) and counted.since() == 3
    for name in glob.glob(f"{path}/data/part=2/*.parquet"):  # rows that are lost without a word
        shutil.os.remove(name)
    assert got(stages.stage(spark.createDataFrame(changed, SCHEMA), counted, path)) == want(changed) and counted.since() == 3
    spark.createDataFrame([("d30", "forged", 1)], "doc string, text string, _run int").write.mode("append").parquet(f"{path}/data/part=3")
    assert got(stages.stage(spark.createDataFrame(changed, SCHEMA), counted, path)) == want(changed) and counted.since() == 3
    more = [*changed, (9, "d90", "x")]
    assert got(stages.stage(spark.createDataFrame(more, SCHEMA), counted, path)) == want(more) and counted.since() == 1
    fewer = [r for r in more if r[0] != 0]  # parts that left the input are not in the result
    assert got(stages.stage(spark.createDataFrame(fewer, SCHEMA), counted, path)) == want(fewer) and counted.since() == 0


def test_version_and_parts_without_rows(spark, tmp_path, counted):
    path, rows = str(tmp_path / "s"), [(0, "a", "gone"), (1, "b", "stays")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(stages.stage(df, counted, path)) == want(rows) and counted.since() == 2
    assert got(stages.stage(df, counted, path)) == want(rows) and counted.since() == 0
    assert got(stages.stage(df, counted, path, version="2")) == want(rows) and counted.since() == 2
    now = [(0, "a", "gone"), (1, "b", "gone")]  # a part that had rows has none now
    assert got(stages.stage(spark.createDataFrame(now, SCHEMA), counted, path, version="2")) == [] and counted.since() == 1
    assert stages.stage(df.filter("false"), counted, path, version="2").count() == 0 and counted.since() == 0


def test_a_run_that_dies_before_its_entry_is_made_again(spark, tmp_path, counted):
    path, df = str(tmp_path / "s"), spark.createDataFrame(ROWS, SCHEMA)
    stages.stage(df, counted, path)
    counted.since()
    shutil.rmtree(f"{path}/manifest")
    assert got(stages.stage(df, counted, path)) == want(ROWS) and counted.since() == len(ROWS)


def test_stages_pass_on_only_what_changed(spark, tmp_path):
    first, second = Counted(spark), Counted(spark)

    def both(rows):
        return stages.stage(stages.stage(spark.createDataFrame(rows, SCHEMA), first, str(tmp_path / "a")), second, str(tmp_path / "b"))

    both(ROWS)
    assert (first.since(), second.since()) == (12, 12)
    assert got(both([(p, d, "other" if d == "d20" else t) for p, d, t in ROWS])) and (first.since(), second.since()) == (3, 3)
    assert got(both([(p, d, "OTHER" if d == "d20" else t) for p, d, t in ROWS])) and (first.since(), second.since()) == (3, 0)  # made again, with the same result
