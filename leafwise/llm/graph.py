"""Connected components over links, by alternating star steps.

Each round every node links to the smallest node it knows (first for its larger
neighbours, then for its smaller ones), so the depth of the trees falls by half
or so and the number of links never grows. Rounds are written to the shared
folder; a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool


def _star(links: DataFrame, *, large: bool) -> DataFrame:
    """One star step: neighbours of a node go to the smallest of the node and its neighbours.

    The large star moves the larger neighbours, the small star the smaller ones
    and the node itself. Both need the least neighbour only, so a node with very
    many links is a join on its least, not a list of them.
    """
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
    met = both.join(least, "a")
    if large:
        made = met.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        made = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return made.filter("a <> b").distinct()


def components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that each linked node reaches. `links`: a, b of one integer type."""
    links = spool(links.select("a", "b").filter("a <> b").distinct())
    mark = None
    for _ in range(rounds):
        links = spool(_star(_star(links, large=True), large=False))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first()
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
