"""Row anchors and percentiles of groups of any size, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leafwise.operators import metrics, reconcile


def brute_rows(words, tolerance=3.0):
    out = {}
    for page in {w[0] for w in words}:
        own = sorted((w for w in words if w[0] == page), key=lambda w: w[1])
        anchor, nr = None, -1
        for _, y, x, t in own:
            if anchor is None or y - anchor > tolerance:
                anchor, nr = y, nr + 1
            out.setdefault((page, nr), []).append((x, y, t))
    return sorted((p, nr, [t for _, _, t in sorted(ws)]) for (p, nr), ws in out.items())


@pytest.mark.parametrize("dense", [True, False])
def test_rows_over_range_partitions(spark, tmp_path, dense):
    rnd = random.Random(dense)
    ys = (lambda: rnd.random() * 60) if dense else (lambda: float(rnd.randrange(500)))
    words = [("big", ys(), rnd.random(), f"w{i}") for i in range(2500)] + [(f"p{i % 40}", ys(), rnd.random(), f"s{i}") for i in range(300)]
    words += [("edge", 0.1 * k, 0.0, f"e{k}") for k in range(200)] + [("gap", 0.0, 0.0, "g0"), ("gap", 1000.0, 0.0, "g1")]
    df = spark.createDataFrame(words, "page string, y_min double, x_min double, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = reconcile.visual_rows(df, page=["page"], path=f"{tmp_path}/h").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r.page, r.row_nr, r.words) for r in got) == brute_rows(words)
    assert reconcile.visual_rows(df.filter("false"), page=["page"], path=f"{tmp_path}/none").count() == 0


def test_crossing_tells_every_anchor():
    import numpy as np

    rnd = random.Random(4)
    for _ in range(60):
        ys = np.array(sorted({round(rnd.random() * rnd.choice([2, 9, 40]), rnd.choice([0, 1, 6])) for _ in range(rnd.randint(1, 80))}))
        entries, exits = reconcile._crossing(ys, 3.0)
        for anchor in [ys[0] - d for d in (0.0, 0.5, 1.7, 3.0, 3.1, 8.0)]:
            last = anchor
            for y in ys:
                last = y if y - last > 3.0 else last
            hit = next((i for i, e in enumerate(entries) if e - anchor > 3.0), -1)
            assert (anchor if hit < 0 else exits[hit]) == last


def brute_rank(values, p, rule):
    own = sorted(values, key=lambda v: (math.isnan(v), v))
    return own[max(math.ceil(len(own) * p), 1) - 1] if rule == "nearest" else own[math.floor((len(own) - 1) * p)]


@pytest.mark.parametrize("rule", ["nearest", "floor"])
def test_ranks_equal_brute_force(spark, tmp_path, rule):
    rnd = random.Random(7)
    groups = {
        "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300) for _ in range(900)],
        "ties": [rnd.choice([1.0, 2.0, 2.0, 2.0, 7.5]) for _ in range(700)],
        "near": [1 + rnd.randrange(2000) * 2**-52 for _ in range(800)],
        "odd": [math.inf, -math.inf, math.nan, 0.0, 5e-324, -1.7e308, 1.7e308] * 60,
        "one": [3.25],
        None: [float(i) for i in range(400)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("wide", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares = {"low": 0.0, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.g: r for r in metrics.ranks(df, group="g", value="v", shares=shares, path=f"{tmp_path}/r", rule=rule, few=20).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in shares.items():
            want = brute_rank(vs, p, rule)
            assert got[g][name] == want or (math.isnan(want) and math.isnan(got[g][name])), (g, name)
    assert metrics.ranks(df.filter(F.col("v").isNull()), group="g", value="v", shares=shares, path=f"{tmp_path}/e").count() == 0
