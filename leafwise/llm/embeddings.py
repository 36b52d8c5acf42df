"""Embedding near-duplicates by NN-descent (operator 3).

Equal vectors of a label are one point with a weight. A first neighbour graph
comes from random orders: each order turns the vectors at random and sorts a
label's points by their largest coordinate and one projection; overlapping windows
of the sorted points are compared inside. Then the graph is refined: a point's
neighbours, forward and backward, are gathered with their vectors, and neighbours
of neighbours are compared where one of the two links is new. Lists keep the K
nearest; a list that is full of links at the threshold is saturated and is
enlarged to WIDE. What is linked among the vectors that were compared together is
kept apart from the lists, so no cut of a list loses it.

Components are the vectors reached by links. Links are then counted within
components, so those that no list held count too. A component's points are cut
into tiles of near points, each with a centre and a radius. For two tiles whose
centres and radii say that all pairs are links, or none, no vector is looked at;
only the tiles in between are compared, in one bounded task for each pair.

An audit compares a hashed sample (doubled until it has met LEAST links, up to
MOST points) with all points of its labels and measures the share of links whose
two ends share a component. While it is below `recall`, further orders follow;
the last graph is audited too, and a recall below `recall` raises.

Hot lists: backward neighbours are dealt in groups of GROUP, so a point that
very many others name becomes many small groups, none of them unbounded.

Defined results: vectors that are null, zero or hold null or non-finite parts,
and rows with null labels, link with nothing and are returned as themselves;
vectors of different lengths never link; rows that repeat a vec_id are one
vector if they agree, else each counts and the row of the vec_id has the larger
number of links and the smaller component; a null vec_id is one row without
links; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept_from, spool, table
from .graph import components

K, WIDE = 12, 48
ORDERS, WINDOW = 8, 128
GROUP = 96
TILE = 1024
#: Points of an audit: at first, at most, and the links that are enough.
AUDITED, MOST, LEAST = 2048, 16_384, 400
#: Stands in the place of a cosine where two points are linked over others.
LINKED = 2.0
_PAIRS = "a long, b long, sim double"


def points_of(vectors: DataFrame) -> DataFrame:
    """point (least vec_id), label, v, n: the distinct usable vectors of each label and how many vec_ids have them. `v` keeps its kind of number."""
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("v")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0")
    fine = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    return fine.groupBy("label", "v").agg(F.min("vec_id").alias("point"), F.count_distinct("vec_id").alias("n"))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of unit length, a row each; shorter ones are filled up with zeros. They are scaled by their largest part first, so that no square leaves the range of doubles."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.zeros((len(column), int(lengths.max(initial=1))))
    x[np.arange(x.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=5e-324)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def slice_of(part: dict[str, np.ndarray], a: int, b: int) -> dict[str, np.ndarray]:
    return {c: x[a:b] for c, x in part.items()}


def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """A batch's columns as arrays; `v` as unit vectors, `length` as their lengths."""
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "v"}
    return out | {"v": unit_rows(batch.column("v")), "length": pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)}


def joined(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    wide = max(a["v"].shape[1], b["v"].shape[1])
    grow = lambda x: np.pad(x, ((0, 0), (0, wide - x.shape[1])))
    return {c: np.concatenate([grow(a[c]), grow(b[c])] if c == "v" else [a[c], b[c]]) for c in a}


def windows(given: Iterator[pa.RecordBatch], keys: list[str], width: int, step: int) -> Iterator[dict[str, np.ndarray]]:
    """Windows of up to `width` rows, `step` apart, over the runs of equal keys of sorted rows. Less than a window is held from batch to batch."""
    held: dict[str, np.ndarray] | None = None
    for batch in given:
        if not batch.num_rows:
            continue
        now = arrays(batch)
        if held is not None:
            now = joined(held, now)
        change = np.zeros(len(now["v"]) - 1, bool)
        for k in keys:
            change |= now[k][1:] != now[k][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(now["v"])]
        for nr, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            last = nr == len(cuts) - 2
            while b - a > width or (not last and b - a):
                yield slice_of(now, a, min(b, a + width))
                if b - a <= width:
                    a = b
                    break
                a += step
            if last:
                held = slice_of(now, a, b)
    if held is not None and len(held["v"]):
        yield held


def groups_of(near: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric table of links reaches."""
    low = np.arange(len(near))
    while True:
        now = np.minimum(low, np.where(near, low, len(near)).min(axis=1, initial=len(near)))
        now = now[now]
        if (now == low).all():
            return low
        low = now


def best_pairs(part: dict[str, np.ndarray], threshold: float, keep: int = K) -> pa.RecordBatch | None:
    """The `keep` nearest of each row among the others of its label and length, more where they are links, and which rows are linked over others."""
    n, ids = len(part["v"]), part["point"]
    if n < 2:
        return None
    sim = part["v"] @ part["v"].T
    for c in ("label", "length"):
        if (part[c] != part[c][0]).any():
            sim[part[c][:, None] != part[c]] = -3
    np.fill_diagonal(sim, -3)
    k = min(keep, n - 1)
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    best = np.take_along_axis(sim, top, 1).ravel()
    fine = best > -2
    a, b, s = np.repeat(ids, k)[fine], ids[top].ravel()[fine], best[fine]
    near = sim >= threshold
    if near.any():
        low = groups_of(near)
        far = np.flatnonzero(low != np.arange(n))
        a, b, s = np.concatenate([a, ids[far]]), np.concatenate([b, ids[low[far]]]), np.concatenate([s, np.full(len(far), LINKED)])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], names=["a", "b", "sim"])


def gathered(parts: Iterator[pa.RecordBatch | None], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Small batches put together."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if part is not None:
            held.append(part)
        if sum(p.num_rows for p in held[-1:]) and len(held) * max(1, held[-1].num_rows) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def turned(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(place and sign of the largest coordinate, a projection) of unit vectors after a random turn."""
    rng = np.random.default_rng([seed, x.shape[1]])
    q, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    y = x @ q
    at = np.abs(y).argmax(axis=1)
    return 2 * at + (y[np.arange(len(y)), at] > 0), x @ rng.standard_normal(x.shape[1])


def ordered_windows(points: DataFrame, seeds: range, threshold: float, window: int = WINDOW) -> DataFrame:
    """a, b, sim: near pairs inside windows of the orders of each label's points, one order for each seed.

    Orders are range partitioned by (order, label, corner, projection); windows overlap by half.
    """
    vector = points.schema["v"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            x, lengths = unit_rows(v), pc.list_value_length(v).to_numpy(zero_copy_only=False)
            for seed in seeds:
                corner, along = np.zeros(len(x), np.int64), np.zeros(len(x))
                for n in np.unique(lengths):
                    own = lengths == n
                    corner[own], along[own] = turned(x[own, :n], seed)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("point", "label", "v")), pa.array(np.full(len(x), seed, np.int32)), pa.array(corner), pa.array(along)], names=["point", "label", "v", "nr", "corner", "along"])

    coded = points.select("point", "label", "v").mapInArrow(code, f"point long, label int, v {vector}, nr int, corner long, along double")
    order = ["nr", "label", "corner", "along", "point"]
    dealt = coded.repartitionByRange(*order).sortWithinPartitions(*order)

    def compare(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(best_pairs(part, threshold) for part in windows(given, ["nr", "label"], window, window // 2))

    return dealt.mapInArrow(compare, _PAIRS)


def nearest(pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b, sim, fresh: each point's K nearest, of links up to WIDE. A pair that was seen before is not fresh."""
    one = pairs.filter(F.col("sim") < LINKED).groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    placed = one.withColumn("place", F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b"))).filter(F.col("place") <= WIDE)
    return placed.filter((F.col("place") <= K) | (F.col("sim") >= threshold)).drop("place")


def links_of(pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs that are links or linked over others, each once."""
    return pairs.filter(F.col("sim") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def descend(points: DataFrame, graph: DataFrame, threshold: float, member: DataFrame | None = None) -> DataFrame:
    """a, b, sim from one round: neighbours of neighbours, where one of the two links is fresh.

    `member` (point, component): what is joined already. Points all of whose
    neighbours are in one component cannot join anything, so theirs are not compared.
    """
    both = graph.select("a", "b", "fresh").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "fresh")).groupBy("a", "b").agg(F.max("fresh").alias("fresh"))
    if member is not None:
        known = member.select(F.col("point").alias("b"), F.col("component").alias("of"))
        spread = both.join(known, "b", "left").groupBy("a").agg(F.min(F.coalesce("of", "b")).alias("low"), F.max(F.coalesce("of", "b")).alias("high"))
        both = both.join(spread.filter("low < high").select("a"), "a", "left_semi")
    # Long lists are dealt over groups by a hash of the neighbour.
    sizes = both.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"), F.max("fresh").alias("any")).filter("any = 1")
    met = both.join(sizes, "a").withColumn("g", F.pmod(F.xxhash64("a", "b"), F.col("groups"))).select("a", "b", "g")
    met = met.join(points.select(F.col("point").alias("b"), "label", "v"), "b")

    dealt = met.withColumnRenamed("b", "point").repartition("a", "g").sortWithinPartitions("a", "g")
    return dealt.mapInArrow(lambda given: gathered(best_pairs(part, threshold) for part in windows(given, ["a", "g"], 4 * GROUP, 2 * GROUP)), _PAIRS)


def refine(points: DataFrame, pairs: DataFrame, threshold: float, *, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(graph, links) after up to `rounds` rounds from compared `pairs` (a, b, sim, fresh); it stops when a round finds no new link."""
    graph, links = spool(nearest(pairs, threshold)), spool(links_of(pairs, threshold))
    # What the orders have joined already: dense groups are mostly one component by now.
    member = spool(components(links).select(F.col("node").alias("point"), "component"))
    for _ in range(rounds):
        found = spool(descend(points, graph, threshold, member).withColumn("fresh", F.lit(1)))
        graph = spool(nearest(found.unionByName(graph.withColumn("fresh", F.lit(0))), threshold))
        more = links_of(found, threshold).join(links, ["a", "b"], "left_anti")
        if more.isEmpty():
            break
        links = spool(links.unionByName(more))
    return graph, links


def audit(points: DataFrame, member: DataFrame, threshold: float) -> float:
    """Share of the links of a hashed sample of points, found by comparing them with all points of their label, within components.

    `member`: point, component. The sample (up to MOST points) goes to the tasks,
    which read the points once for each size of it.
    """
    rows = points.join(member, "point", "left").select("point", "label", "v", F.coalesce("component", "point").alias("component"))
    size = AUDITED
    while True:
        asked = rows.orderBy(F.xxhash64("point", F.lit(5)), "point").limit(size).toArrow()
        if not asked.num_rows:
            return 1.0
        ask = arrays(asked.combine_chunks().to_batches()[0])

        def compare(batches: Iterator[pa.RecordBatch], ask: dict = ask) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = hit = 0
                if batch.num_rows:
                    own = arrays(batch)
                    wide = min(own["v"].shape[1], ask["v"].shape[1])
                    for at in range(0, len(ask["v"]), 1024):
                        q = slice_of(ask, at, at + 1024)
                        near = q["v"][:, :wide] @ own["v"][:, :wide].T >= threshold
                        for c in ("label", "length"):
                            near &= q[c][:, None] == own[c]
                        near &= q["point"][:, None] != own["point"]
                        n += int(near.sum())
                        hit += int((near & (q["component"][:, None] == own["component"])).sum())
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([hit])], names=["n", "hit"])

        row = rows.mapInArrow(compare, "n long, hit long").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).first()
        if row["n"] >= LEAST or asked.num_rows < size or size >= MOST:
            return row["hit"] / row["n"] if row["n"] else 1.0
        size *= 2


def tiles_of(points: DataFrame, member: DataFrame) -> DataFrame:
    """component, tile, point, n, v: the points of components in tiles of TILE near points at most; `tile` is unique."""
    kind = points.schema["v"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                corner, along = turned(unit_rows(batch.column("v")), 0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(corner), pa.array(along)], names=[*batch.schema.names, "corner", "along"])

    coded = points.join(member, "point").select("component", "point", "n", "v").mapInArrow(code, f"component long, point long, n long, v {kind}, corner long, along double")
    order = ["component", "corner", "along", "point"]
    ordered = coded.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nr, held, last = TaskContext.get().partitionId() << 40, 0, 0, None
        for batch in batches:
            tile = []
            for c in batch.column("component").to_pylist():
                if c != last or held == TILE:
                    nr, held, last = nr + 1, 0, c
                held += 1
                tile.append(part + nr)
            yield pa.RecordBatch.from_arrays([batch.column("component"), pa.array(tile, pa.int64()), *(batch.column(c) for c in ("point", "n", "v"))], names=["component", "tile", "point", "n", "v"])

    return ordered.mapInArrow(cut, f"component long, tile long, point long, n long, v {kind}")


def count_links(points: DataFrame, member: DataFrame, threshold: float) -> DataFrame:
    """point, outer: the weight of the other points that each point of a component links to."""
    tiles = spool(tiles_of(points, member))
    angle, slack = float(np.arccos(threshold)), 1e-7

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in windows(batches, ["tile"], TILE, TILE):
            centre = part["v"].sum(axis=0)
            norm = np.linalg.norm(centre)
            centre = centre / norm if norm > 0 else part["v"][0]
            radius = float(np.arccos(np.clip(part["v"] @ centre, -1, 1)).max())
            even = bool((part["length"] == part["length"][0]).all())
            yield pa.RecordBatch.from_arrays([pa.array(part["component"][:1]), pa.array(part["tile"][:1]), pa.array([int(part["n"].sum())]), pa.array([radius if even else 9.0]), pa.array([centre.tolist()])], names=["component", "tile", "weight", "radius", "centre"])

    outlines = spool(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(outline, "component long, tile long, weight long, radius double, centre array<double>"))
    # Outlines of a component's tiles meet each other; they are a thousandth of its points.
    x, y = outlines.alias("x"), outlines.alias("y")
    dot = F.aggregate(F.zip_with("x.centre", "y.centre", lambda p, q: p * q), F.lit(0.0), lambda acc, p: acc + p)
    apart = F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)))
    reach = F.col("x.radius") + F.col("y.radius")
    met = x.join(y, (F.col("x.component") == F.col("y.component")) & (F.col("x.tile") <= F.col("y.tile")))
    judged = met.select(F.col("x.tile").alias("i"), F.col("y.tile").alias("j"), F.col("x.weight").alias("wi"), F.col("y.weight").alias("wj"), F.when(apart + reach < angle - slack, "all").when(apart - reach > angle + slack, "none").otherwise("some").alias("kind"))
    judged = spool(judged.filter("kind <> 'none'"))
    whole = judged.filter("kind = 'all'")
    given = whole.select(F.col("i").alias("tile"), F.col("wj").alias("w")).unionByName(whole.filter("i <> j").select(F.col("j").alias("tile"), F.col("wi").alias("w"))).groupBy("tile").agg(F.sum("w").alias("w"))
    own = whole.filter("i = j").select(F.col("i").alias("tile"), F.lit(1).alias("self"))
    sure = tiles.join(given, "tile").join(own, "tile", "left").select("point", (F.col("w") - F.coalesce("self", F.lit(0)) * F.col("n")).alias("outer"))

    some = judged.filter("kind = 'some'").select("i", "j")
    sent = some.select("i", "j", F.col("i").alias("tile")).unionByName(some.filter("i <> j").select("i", "j", F.col("j").alias("tile"))).join(tiles, "tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts():
            for part in windows(batches, ["i", "j"], 2 * TILE, 2 * TILE):
                left, right, ids, n = part["tile"] == part["i"], part["tile"] == part["j"], part["point"], part["n"]
                near = (part["v"][left] @ part["v"][right].T >= threshold) & (part["length"][left][:, None] == part["length"][right])
                if part["i"][0] == part["j"][0]:
                    np.fill_diagonal(near, False)
                    out = ids, near @ n
                else:
                    out = np.concatenate([ids[left], ids[right]]), np.concatenate([near @ n[right], near.T @ n[left]])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["point", "outer"])

        return gathered(counts())

    dealt = sent.select("i", "j", "tile", "point", "n", "v").repartition("i", "j").sortWithinPartitions("i", "j", "tile", "point")
    met = dealt.mapInArrow(compare, "point long, outer long")
    return sure.unionByName(met).groupBy("point").agg(F.sum("outer").alias("outer"))


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.93, recall: float = 0.99, tries: int = 4) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector. The audit has to reach `recall` within `tries` tries, or this raises."""
    points = spool(points_of(vectors))
    found = ordered_windows(points, range(ORDERS), threshold).withColumn("fresh", F.lit(1))
    graph, links, upto, measured = None, None, ORDERS, 0.0
    for _ in range(tries):
        pairs = spool(found if graph is None else found.unionByName(graph.withColumn("fresh", F.lit(0))))
        graph, new = refine(points, pairs, threshold, rounds=3)
        links = new if links is None else spool(links.unionByName(new).distinct())
        member = spool(components(links).select(F.col("node").alias("point"), "component"))
        measured = audit(points, member, threshold)
        if measured >= recall:
            break
        found = ordered_windows(points, range(upto, 2 * upto), threshold).withColumn("fresh", F.lit(1))
        upto *= 2
    else:
        raise RuntimeError(f"the audit found {measured:.4f} of the links, {recall} are asked for")
    outer = count_links(points, member, threshold)
    named = points.join(outer, "point", "left").join(member, "point", "left").select("label", "v", (F.coalesce("outer", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "point").alias("component_id"))
    of = vectors.select("vec_id", "label", F.col("embedding").alias("v")).join(named, ["label", "v"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select("vec_id").distinct().join(of, "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and decision of every vector."""
    return kept_from(spark, lambda: near_duplicates(table(spark, sf_dir, "embeddings")))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT DISTINCT e.vec_id, coalesce(n_links, 0) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least_of lo ON lo.a = e.vec_id
"""
