"""SimHash near-duplicates with pigeonring filtering (operator 9).

Fingerprints are cut into four segments set in a ring. Two fingerprints that
differ in at most `most` bits have a segment from which every chain of
consecutive segments keeps its summed differences within the proportional
budget, most * length / 4. With `most` of 2 or 3 the chain starts with an equal
segment, and at least one more segment is equal when `most` is 2; pairs of equal
segments are the join keys, the chain test prunes what they bring together, and
the full Hamming distance decides.

Only distinct fingerprints are compared, so thousands of copies are one. A key
that very many fingerprints share is not joined with itself: its fingerprints
meet at the fingerprints one bit away from them. Two lie within two bits exactly
if they share such a point, and all that share one lie within two bits of each
other, so linking each to the point's smallest loses nothing and makes no pairs.

Defined results: null texts count as empty; texts without words have fingerprint
zero and link with each other; a null doc_id is never linked to (its component
is null); repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import kept_from, map_texts, spool, table, texts
from .graph import components

SEGMENTS = 4
#: Fingerprints under one key up to which they are compared pair by pair.
PAIRWISE = 24


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles: a bit is set that is set in over half of the hashes."""
    w = text.encode().lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxh64_intdigest(b" ".join(w), 42)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[:-words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    return majority(np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype=">u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (big-endian 64-bit)."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def start() -> Callable[[str], tuple]:
        return lambda text: (int(np.int64(np.uint64(fingerprint(text, words)))),)

    return map_texts(texts(docs), start, "doc_id long, fp long")


def segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def chain_fits(diff: Column, most: int) -> Column:
    """Whether some segment starts chains of all lengths whose summed differences stay within most * length / 4."""
    per = [F.bit_count(segment(diff, i)) for i in range(SEGMENTS)]
    starts = []
    for first in range(SEGMENTS):
        total, fits = F.lit(0), F.lit(True)
        for n in range(1, SEGMENTS + 1):
            total = total + per[(first + n - 1) % SEGMENTS]
            fits = fits & (total * SEGMENTS <= most * n)
        starts.append(fits)
    any_start = starts[0]
    for s in starts[1:]:
        any_start = any_start | s
    return any_start


def links_within(points: DataFrame, most: int = 2) -> DataFrame:
    """a, b: links that join all `points` (id, fp; fp distinct) within `most` (up to 2) differing bits."""
    if not 0 <= most <= 2:
        raise ValueError("most is 0, 1 or 2")
    pairs = list(combinations(range(SEGMENTS), 2))
    # Segments i and j equal: a key of 32 bits, told apart by which two they are.
    key = lambda i, j, nr: F.struct(F.lit(nr).alias("nr"), F.shiftleft(segment(F.col("fp"), i), 16).bitwiseOR(segment(F.col("fp"), j)).alias("bits"))
    keyed = points.select("id", "fp", F.explode(F.array(*[key(i, j, nr) for nr, (i, j) in enumerate(pairs)])).alias("k")).select("id", "fp", F.xxhash64("k.nr", "k.bits").alias("k"))
    sized = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    shared = spool(keyed.join(sized, "k"))
    few = shared.filter(F.col("n") <= PAIRWISE)
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    near = few.alias("x").join(few.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id")) & chain_fits(diff, most) & (F.bit_count(diff) <= most))
    links = near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    many = shared.filter(F.col("n") > PAIRWISE).select("id", "fp").distinct()
    return links.unionByName(_meet(many, most))


def _meet(points: DataFrame, most: int) -> DataFrame:
    """Links of dense points by way of the fingerprints one bit (for `most` of 1 or 0: no further than that) away."""
    if most == 0:
        return points.select(F.col("id").alias("a"), F.col("id").alias("b")).filter("false")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(int(np.int64(np.uint64(1 << i)))) for i in range(64)])
    at = points.select("id", "fp", F.explode(flips).alias("flip")).select("id", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    if most == 1:  # a point stands for those one bit from it only if it is a fingerprint itself
        own = points.select(F.col("fp").alias("z"), F.col("id").alias("low"))
        return at.join(own, "z").filter("low < id").select(F.col("low").alias("a"), F.col("id").alias("b"))
    low = at.groupBy("z").agg(F.min("id").alias("low"), F.count("*").alias("n")).filter("n > 1")
    return at.join(low, "z").filter("low < id").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()


def simhash_components(docs: DataFrame, *, words: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that each document reaches by links."""
    prints = spool(fingerprints(docs, words=words))
    points = prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id"))
    found = components(links_within(points, most))
    named = points.join(found, points["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = kept_from(spark, lambda: simhash_components(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
