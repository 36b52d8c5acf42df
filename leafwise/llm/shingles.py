"""Near copies by their exact sets of word shingles (second stage of the pipeline).

Two texts are near copies if the sets of their word shingles have a Jaccard
similarity of 4/5 or more. All such pairs share a shingle among the first
n - ceil(4n/5) + 1 of each set, in whatever order shingles are taken, as long as
it is the same for all sets; those prefixes are the join keys, so no pair is
lost. Shingles that a sample shows to be frequent are taken last, which only
makes keys small. What the keys bring together is confirmed by the exact sets.

Equal sets are one point. Points first meet by SimHash with pigeonring, as in
operator 9: each is paired with the least point that its fingerprint reaches, and
the exact sets confirm the pair. What 64 bits cannot tell (most pairs below a
similarity of 0.9) is left to the keys: under each key whose points are not
joined yet, those apart from the key's least point meet it, which takes a linear
number of pairs; points that are apart even then are
compared pair by pair, dense keys in tiles. Before the sets
of a pair are sent, their parity bitmaps are compared: they differ in no more
bits than the sets differ in shingles, so this too loses nothing. Points of
dense keys are compared so within the join itself, which gives only the pairs
that are left; what is left anywhere is compared by bitmaps as long as the sets,
as short ones tell long sets apart badly.

Defined results: null texts count as empty; texts without words are copies of
each other; texts with fewer words than a shingle have one shingle of all words;
null doc_ids come last, and their rows are told apart by their text; rows that
repeat a doc_id and a text are one document, rows that share a doc_id and differ
in text are several; texts of any length are taken whole; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import forget, kept_from, let_go, slices, spool, text_hash, texts
from .graph import components
from .simhash import links_within, majority

#: One text in SAMPLE is read for frequent shingles; those it shows FREQUENT times or more go last, up to LISTED of them.
SAMPLE, FREQUENT, LISTED = 16, 4, 200_000
#: Points of a tile of a dense key; pairs that a leader's group holds.
TILE, GROUP = 256, 512
#: Asked texts, or linked sets, up to which their list is broadcast.
BROADCAST = 300_000
#: Bytes of texts or sets that a task takes apart at once.
BYTES = 1 << 21
#: Longs of a parity bitmap.
LONGS = 8
#: Points of a key beyond which their bitmaps are compared within the join.
DENSE = 24


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[:-words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist() or [len(joined)]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64))


def prefix_length(n: int) -> int:
    """Shingles of a set of `n` of which one is in every set of similarity 4/5 or more."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def parities(s: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """A bitmap of a set: each bit is the parity of the number of shingles that fall on it."""
    odd = np.bincount((s % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parities(s: np.ndarray) -> np.ndarray:
    """The bitmap with two bits or more for a shingle; its length is a power of two."""
    return parities(s, max(LONGS, 1 << (max(len(s) - 1, 0) >> 5).bit_length()))


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles in which the sets of two bitmaps differ at least; the longer one is folded to the shorter one's length."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 4/5 or more: 9 * common >= 4 * (sum of the sizes)."""
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text's hash), text."""
    return texts(docs).withColumn("t", text_hash(F.col("text")))


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that a sample of the texts holds often, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in (part for whole in batches for part in slices(whole, "text", BYTES)):
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words).view(np.int64))], names=["k"])

    sample = _keyed(docs).filter(F.pmod("t", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "k long")
    often = sample.groupBy("k").count().filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "k").limit(LISTED)
    return np.sort(np.array([r["k"] for r in often.select("k").collect()], np.int64).view(np.uint64))


def prefixes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, t, h (the set's hash), n (its size), bits (its parities), fp (its SimHash), prefix."""
    last = frequent(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in (part for whole in batches for part in slices(whole, "text", BYTES)):
            h, n, bits, fp, kept = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, words)
                late = np.isin(s, last, assume_unique=True)
                h.append(xxh64_intdigest(s.tobytes(), 7))
                n.append(len(s))
                bits.append(parities(s))
                fp.append(majority(s.astype(">u8")))
                kept.append(np.concatenate([s[~late], s[late]])[: prefix_length(len(s))])
            offsets = pa.array(np.cumsum([0, *map(len, kept)]), pa.int32())
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *kept]).view(np.int64))
            columns = [batch.column("doc_id"), batch.column("t"), pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(n, pa.int64())]
            columns += [pa.array(bits, pa.list_(pa.int64())), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "h", "n", "bits", "fp", "prefix"])

    return _keyed(docs).select("doc_id", "t", "text").mapInArrow(run, "doc_id long, t long, h long, n long, bits array<long>, fp long, prefix array<long>")


def starred(points: DataFrame) -> DataFrame:
    """a, b: each point and the least one that its fingerprint reaches by pigeonring, a pair for a point."""
    prints = points.groupBy("fp").agg(F.min("h").alias("id"))
    found = components(links_within(prints))
    named = prints.join(found, prints["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("a"))
    return points.join(named, "fp").select("a", F.col("h").alias("b")).filter("a <> b")


def possible(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """The `pairs` whose bitmaps allow the similarity: sets of similarity 4/5 differ in a ninth of their sizes' sum at most."""
    of = lambda c: points.select(F.col("h").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    return met.filter(_allowed(F.col("bitsa"), F.col("bitsb"), F.col("na"), F.col("nb"))).select("a", "b")


def _allowed(x: Column, y: Column, nx: Column, ny: Column) -> Column:
    differ = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(LONGS)), F.lit(0))
    return 9 * differ <= nx + ny


def _built(docs: DataFrame, points: DataFrame, pairs: DataFrame, words: int, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """h, n, s: for each point of `pairs` its number of shingles and the bytes of what `make` gives of its set."""
    asked = spool(points.select("h", "rep.doc_id", "rep.t").join(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "h", "left_semi"))
    how = "broadcast" if asked.count() <= BROADCAST else "shuffle_hash"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in (part for whole in batches for part in slices(whole, "text", BYTES)):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(map(len, sets), pa.int64()), pa.array([make(s).tobytes() for s in sets], pa.binary())], names=["h", "n", "s"])

    # Rows that repeat a doc_id and a text only repeat links.
    met = _keyed(docs).alias("x").join(asked.alias("y").hint(how), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.t") == F.col("y.t")))
    return spool(met.select("h", "text").mapInArrow(build, "h long, n long, s binary"))


def _left_by_bitmaps(docs: DataFrame, points: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The `pairs` that the sets' wide bitmaps allow, a small part of the sets' own bytes."""
    maps = _built(docs, points, pairs, words, wide_parities)
    of = lambda c: maps.select(F.col("h").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in (part for whole in batches for part in slices(whole, "sa", BYTES)):
            sides = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True)
            fits = [9 * least_difference(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) <= nx + ny for nx, ny, x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return spool(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(judge, "a long, b long"))


def confirmed(docs: DataFrame, points: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """a, b of those `pairs` of points whose sets are similar. Only sets of pairs that bitmaps allow are sent; a leader with many pairs is dealt over groups."""
    pairs = _left_by_bitmaps(docs, points, pairs, words)
    sets = _built(docs, points, pairs, words, lambda s: s).select("h", "s")
    sized = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = pairs.select("a", "b").join(sized, "a").withColumn("g", F.pmod(F.xxhash64("b"), F.col("groups"))).select("a", "g", "b")
    members = dealt.join(sets.withColumnRenamed("h", "b"), "b").select("a", "g", F.lit(1).alias("kind"), "b", "s")
    leaders = dealt.select("a", "g").distinct().join(sets.withColumnRenamed("h", "a"), "a").select("a", "g", F.lit(0).alias("kind"), F.col("a").alias("b"), "s")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        lead = np.zeros(0, np.uint64)
        for batch in (part for whole in batches for part in slices(whole, "s", BYTES)):
            out = []
            for a, kind, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "kind", "b", "s")), strict=True):
                held = np.frombuffer(s, np.uint64)
                if kind == 0:
                    lead = held
                elif similar(lead, held):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    both = leaders.unionByName(members).repartition("a", "g").sortWithinPartitions("a", "g", "kind")
    return both.mapInArrow(judge, "a long, b long")


def _meetings(points: DataFrame, shared: DataFrame) -> DataFrame:
    """a, b: points of different components under one key whose sizes, places in the prefix and bitmaps allow the similarity."""
    key = W.partitionBy("k")
    apart = shared.withColumns({"low": F.min("component").over(key), "high": F.max("component").over(key), "held": F.count("*").over(key)}).filter("low <> high")
    apart = apart.withColumn("tiles", F.ceil(F.col("held") / TILE).cast("int"))
    dealt = spool(apart.withColumn("tile", F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int")).drop("low", "high"))
    few = possible(points, _met(dealt.filter(F.col("held") <= DENSE), F.lit(True)).distinct())
    many = dealt.filter(F.col("held") > DENSE).join(points.select("h", "bits"), "h")
    return few.unionByName(_met(many, _allowed(F.col("x.bits"), F.col("y.bits"), F.col("x.n"), F.col("y.n")))).distinct()


def _met(dealt: DataFrame, more: Column) -> DataFrame:
    """a, b: points of one key and two tiles, or one, that fit and of which `more` holds."""
    x = dealt.withColumn("j", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1))).withColumnRenamed("tile", "i").alias("x")
    y = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tile")))).withColumnRenamed("tile", "j").alias("y")
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))  # common shingles if this one is the first
    fits = (
        (F.col("x.k") == F.col("y.k")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.component") != F.col("y.component"))
        & ((F.col("x.i") < F.col("x.j")) | (F.col("x.h") < F.col("y.h"))) & (9 * left >= 4 * (F.col("x.n") + F.col("y.n"))) & more
    )
    return x.join(y, fits).select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b"))


def near_copies(docs: DataFrame, *, words: int = 5) -> DataFrame:
    """doc_id, t (the text's hash), n_rows, component_id, kept: one row for each distinct document.

    `component_id` is the smallest doc_id that the text reaches over pairs of
    similarity 4/5 or more; the row that has it is kept, on a tie the one with the
    smallest hash.
    """
    prints = spool(prefixes(docs, words))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    points = spool(prints.groupBy("h").agg(F.min(first).alias("rep"), *[F.first(c).alias(c) for c in ("n", "bits", "fp")]))
    spark = docs.sparkSession

    def placed_in(rows: DataFrame, links: DataFrame) -> DataFrame:
        member = spool(components(links).withColumnRenamed("node", "h"))
        how = "broadcast" if member.count() <= BROADCAST else "shuffle_hash"
        if how == "broadcast":  # rows are dealt by key before they get their component, which makes them shorter
            rows = rows.repartition("k")
        return rows.join(member.hint(how), "h", "left").withColumn("component", F.coalesce("component", "h"))

    # Sets are long, so they go as soon as their pairs are judged.
    links = kept_from(spark, lambda: confirmed(docs, points, spool(possible(points, starred(points))), words))
    # Prefixes are read from where they were written first, not written again.
    keyed = prints.groupBy("h").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).select("h", "n", F.posexplode("prefix").alias("pos", "k"))
    packed = keyed.select("h", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("at"), "k")
    key = W.partitionBy("k")
    unpacked = placed_in(packed, links).select("h", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), "k", "component")
    met = unpacked.withColumns({"held": F.count("*").over(key), "low": F.min(F.struct("h", "n", "pos", "component")).over(key), "one": F.min("component").over(key), "other": F.max("component").over(key)})
    shared = spool(met.filter("one <> other").drop("one", "other"))
    left = F.least(F.col("n") - F.col("pos"), F.col("low.n") - F.col("low.pos"))  # common shingles if this one is the first
    apart = shared.filter((F.col("component") != F.col("low.component")) & (9 * left >= 4 * (F.col("n") + F.col("low.n"))))
    led = spool(apart.select(F.col("low.h").alias("a"), F.col("h").alias("b")).distinct())
    links = links.unionByName(kept_from(spark, lambda: confirmed(docs, points, spool(possible(points, led)), words)))
    rest = placed_in(shared.filter("held > 2").select("k", "h", "n", "pos"), links)
    more = kept_from(spark, lambda: _meetings(points, rest).join(led, ["a", "b"], "left_anti"))
    forget(shared)
    if not more.isEmpty():
        links = links.unionByName(kept_from(spark, lambda: confirmed(docs, points, more, words)))
    member = components(links).withColumnRenamed("node", "h")
    placed = points.select("h", "rep").join(member, "h", "left").withColumn("component", F.coalesce("component", "h"))
    least = placed.groupBy("component").agg(F.min("rep").alias("first"))
    firsts = placed.join(least, "component").select("h", "first")
    rows = prints.groupBy("doc_id", "t", "h").agg(F.count("*").alias("n_rows")).join(firsts, "h")
    return rows.select("doc_id", "t", "n_rows", F.col("first.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))).alias("kept"))
