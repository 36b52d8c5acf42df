"""Merkle manifest of a dataset (operator 12).

Each row is a leaf: the hash of its columns, each written as length and value.
Within a group the leaves ascend by their order column; every RUN consecutive
nodes become the hash of their digests until one is left, the group's subroot;
the subroots make the root in the same way. A leaf's proof lists the siblings on
its way up, so one row can be verified without the others.

Leaves are cut into aligned blocks of RUN ** LEVELS. A block is walked in
postorder: a call gives the digest of its subtree and, while unwinding, appends
the siblings it has met to the paths of the leaves below it. The digests of the
blocks are the leaves of the next walk, which is dealt out in the same way, so
the number of rounds is the logarithm of the largest group to the base
RUN ** LEVELS. Texts are hashed where they are read; only digests are shuffled.

Defined results: a null in any column counts as `-`; a null group is a group of
its own and comes first; null order values come first in their group, rows of
equal order by their leaves (rows equal in all columns have equal leaves); a
group of one row has its leaf as subroot, one group its subroot as root; an
empty table has no rows. Further columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept_from, spool, table

#: Nodes that become one, and levels that one block spans.
RUN = 8
LEVELS = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<place:int,siblings:array<string>>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row: of each value `-` if null, else its length in bytes, a colon and itself."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]), 256)


def climb(nodes: list[str], start: int, end: int, height: int, paths: list[list[dict]]) -> str:
    """Digest of the subtree of `height` levels over nodes[start:end]; siblings are appended to the paths of its nodes on the way back."""
    if height == 0:
        return nodes[start]
    span = RUN ** (height - 1)
    cuts = range(start, end, span)
    run = [climb(nodes, at, min(at + span, end), height - 1, paths) for at in cuts]
    for place, at in enumerate(cuts):
        step = {"place": place, "siblings": run[:place] + run[place + 1 :]}
        for path in paths[at : min(at + span, end)]:
            path.append(step)
    return sha256("".join(run).encode()).hexdigest()


def height_of(count: int) -> int:
    """Levels until `count` nodes are one."""
    levels = 0
    while count > 1:
        count, levels = -(-count // RUN), levels + 1
    return levels


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """`nodes` (g and others) with pos, the place in the group by `order` (nulls first), and total, the size of the group.

    Rows are sorted over range partitions, so a group may span any number of
    them; what is counted for each partition and group gives the offsets.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    held = spool(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    held = held.withColumn("part", F.shiftright("at", 33))
    counted = held.groupBy(F.col("g").alias("g_"), F.col("part").alias("part_")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    within = W.partitionBy("g_")
    before = F.sum("n").over(within.orderBy("part_").rowsBetween(W.unboundedPreceding, -1))
    counted = counted.select("g_", "part_", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(within).alias("total"))
    met = held.join(counted, F.col("g").eqNullSafe(F.col("g_")) & (F.col("part") == F.col("part_")))
    return met.select(*nodes.columns, (F.col("at") + F.col("shift")).alias("pos"), "total")


def walked(nodes: DataFrame) -> DataFrame:
    """`nodes` (g, pos, total, node and others) with proof and top: the way up to the digest of the whole group, and that digest."""
    block = RUN**LEVELS
    schema = nodes.withColumns({"block": F.lit(0).cast("long"), "proof": F.lit(None).cast(PROOF), "top": F.lit("")}).schema

    def walk(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        held, total = rows.column("node").to_pylist(), rows.column("total")[0].as_py()
        paths: list[list[dict]] = [[] for _ in held]
        top = climb(held, 0, len(held), LEVELS if total > block else height_of(total), paths)
        kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))
        return rows.append_column("proof", pa.array(paths, kind)).append_column("top", pa.array([top] * len(held)))

    low = spool(nodes.withColumn("block", F.floor(F.col("pos") / block)).groupBy("g", "block").applyInArrow(walk, schema))
    most = low.agg(F.max("total")).first()[0]
    if most is None or most <= block:
        return low.drop("block")
    ups = low.select("g", "block", "top", "total").distinct()
    ups = ups.select("g", F.col("block").alias("pos"), F.ceil(F.col("total") / block).alias("total"), F.col("top").alias("node"))
    high = walked(ups).select(F.col("g").alias("g_"), F.col("pos").alias("block_"), F.col("proof").alias("proof_"), F.col("top").alias("top_"))
    met = low.join(high, F.col("g").eqNullSafe(F.col("g_")) & (F.col("block") == F.col("block_")))
    return met.select(*nodes.columns, F.concat("proof", "proof_").alias("proof"), F.col("top_").alias("top"))


def manifest(rows: DataFrame, *, columns: Sequence[str] = COLUMNS, group: str = "lang", order: str = "doc_id", carried: dict[str, Column] | None = None) -> DataFrame:
    """g, o (group and order value), leaf, proof, subroot, root of every row, and the `carried` columns."""
    carried = carried or {}
    leaves = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), leaf([F.col(c) for c in columns]).alias("node"), *[v.alias(k) for k, v in carried.items()])
    low = walked(numbered(leaves, ["o", "node"]))
    tops = spool(low.select("g", "top").distinct())
    # The subroots are one group, in the order of their groups.
    named = numbered(tops.select(F.lit(0).alias("g"), F.col("g").alias("of"), F.col("top").alias("node")), ["of"])
    high = walked(named).select("of", F.col("proof").alias("last"), F.col("top").alias("root"))
    met = low.join(high, F.col("g").eqNullSafe(F.col("of")))
    return met.select("g", "o", F.col("node").alias("leaf"), F.concat("proof", "last").alias("proof"), F.col("top").alias("subroot"), "root", *carried)


def proof_digest(proof: Column) -> Column:
    """The hash of all siblings of a proof, level by level."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), ""), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def step(digest: Column, s: Column) -> Column:
        before, after = F.slice(s["siblings"], 1, s["place"]), F.slice(s["siblings"], s["place"] + 1, RUN)
        return F.sha2(F.concat(F.array_join(before, ""), digest, F.array_join(after, "")), 256)

    return F.aggregate(proof, start, step)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what its proof says of it after a third of them were tampered with."""
    docs = table(spark, sf_dir, "documents")
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    changed = leaf([F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS])

    def made() -> DataFrame:
        found = manifest(docs, carried={"changed": F.when(struck, changed)})
        out = found.select(F.col("o").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
        return out.withColumn("verified", F.col("folded_root") == F.col("root"))

    return kept_from(spark, made)


def _oracle(levels: int = 12) -> str:
    """The same in DuckDB SQL, for groups of up to RUN ** levels rows: level by level over whole groups."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    row = lambda text: " || ".join(text if c == "text" else value(c) for c in COLUMNS)
    crc = "xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(range(1, strlen(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS UBIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS UBIGINT) FOR k IN range(8)]), lambda x, k: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1)))), CAST(4294967295 AS UBIGINT))"
    first = f"""leaves AS (
  SELECT doc_id, lang AS g, sha256({row(value("text"))}) AS leaf, CASE WHEN {crc} % 3 = 0 THEN sha256({row(value(f"translate(text, '{UPPER}', '{LOWER}')"))}) END AS changed
  FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves)"""
    parts = [first]

    def rise(name: str, start: str) -> str:
        """Levels of nodes (g, pos, node), and the runs they come from; gives the name of the last level."""
        parts.append(f"{name}0 AS ({start})")
        for n in range(levels):
            parts.append(f"{name}r{n} AS (SELECT g, pos // {RUN} AS run, list(node ORDER BY pos) AS nodes, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{n}) GROUP BY ALL)")
            parts.append(f"{name}{n + 1} AS (SELECT g, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS node FROM {name}r{n})")
        return f"{name}{levels}"

    def follow(rows: str, name: str, place: str) -> str:
        """`rows` (g, pos, proof, folded, ...) led through the levels of `name`."""
        for n in range(levels):
            at = f"CAST((x.pos // {RUN**n}) % {RUN} AS BIGINT)"
            before, after = f"array_to_string(r.nodes[1:{at}], '')", f"array_to_string(r.nodes[{at} + 2:], '')"
            before = f"CASE WHEN {at} = 0 THEN '' ELSE {before} END"
            parts.append(f"{place}{n} AS (SELECT x.* REPLACE (CASE WHEN r.n > 1 THEN x.proof || {before} || {after} ELSE x.proof END AS proof, CASE WHEN r.n > 1 THEN sha256({before} || x.folded || {after}) ELSE x.folded END AS folded) FROM {rows} x JOIN {name}r{n} r ON r.g IS NOT DISTINCT FROM x.g AND r.run = CASE WHEN r.n > 1 THEN x.pos // {RUN ** (n + 1)} ELSE 0 END)")
            rows = f"{place}{n}"
        return rows

    low = rise("a", "SELECT g, pos, leaf AS node FROM placed")
    parts.append(f"tops AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, g AS of, node FROM {low})")
    high = rise("b", "SELECT g, pos, node FROM tops")
    parts.append("start AS (SELECT doc_id, leaf, g, pos, '' AS proof, coalesce(changed, leaf) AS folded FROM placed)")
    parts.append(f"turned AS (SELECT x.doc_id, x.leaf, t.node AS subroot, 0 AS g, t.pos, x.proof, x.folded FROM {follow('start', 'a', 'p')} x JOIN tops t ON t.of IS NOT DISTINCT FROM x.g)")
    last = follow("turned", "b", "q")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {last}, (SELECT node AS root FROM {high})"


#: Enough for 8 ** 8 rows of a group.
ORACLE = _oracle(8)
