"""Benchmark decontamination by short seeds and Smith-Waterman alignment (operator 10).

The test items' word n-grams are looked up in every text; runs of hits of one
item make passages. A passage that shares too few words with its item to reach
either bound, in whatever order, is left out in the scan; all others are aligned
with their item by Smith-Waterman over words, so edited, reordered or partial
copies still score. How often an n-gram is found elsewhere does not matter.

The items are the stated query side. They are taken in blocks of BLOCK items
(about that many times fifty n-grams go to every task), whatever their number;
the corpus is read once for each block. Only passages that hit leave the scan.
Equal passages are aligned once.

Defined results: null texts and null items count as empty and match nothing;
items with fewer words than a seed are sought as one n-gram of all their words;
a document is a doc_id, null or not, with a text: rows that repeat both give one
result, rows that share a doc_id and differ in text each their own; repeated
items are one item, items that share an item_id and differ in text match each on
its own; null item_ids are not sought; texts of any length are read whole;
further columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, spool, table, text_hash, texts

#: Words of a seed: a copy with every fourth word changed still holds some.
SEED = 3
#: Items whose n-grams are sent to the tasks at once.
BLOCK = 5_000
#: Words lower-cased, without the punctuation around them.
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
MATCH, DIFFER, GAP = 2, -1, -1

_PASSAGES = "doc_id long, t long, item_id long, passage string"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Seeds:
    """N-grams of a block of items, ready for lookup in texts."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids: dict[str, int] = {}
        grams: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.length: dict[int, int] = {}
        self.bags: dict[int, Counter] = {}  # how often an item holds each word
        for nr, (_, text) in enumerate(items):
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text or "")]
            self.length[nr] = len(w)
            self.bags[nr] = Counter(w)
            if not w:
                continue
            n = min(SEED, len(w))
            for i in range(len(w) - n + 1):
                grams.setdefault((*w[i : i + n], *[0] * (SEED - n)), []).append((nr, i))
        self.sizes = sorted({sum(x > 0 for x in g) for g in grams})
        keys = self.key(np.array(list(grams), np.uint64).reshape(-1, SEED).T)
        order = np.argsort(keys, kind="stable")
        places = list(grams.values())
        self.keys, self.where = keys[order], [places[i] for i in order.tolist()]
        # For each word, the items that hold it and how often: all items' bags in three arrays.
        held = sorted((x, nr, k) for nr, bag in self.bags.items() for x, k in bag.items())
        columns = np.array(held, np.int64).reshape(-1, 3)
        self.holder, self.times = columns[:, 1], columns[:, 2]
        self.first = np.searchsorted(columns[:, 0], np.arange(len(self.ids) + 2))
        self.lengths = np.array([self.length[nr] for nr in range(len(items))], np.int64)
        self.longest = int(self.lengths.max(initial=0))

    @staticmethod
    def key(columns: np.ndarray) -> np.ndarray:
        """One number for each column of word ids (0: no word)."""
        out = np.zeros(columns.shape[1], np.uint64)
        for row in columns:
            out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def known(self, w: list[str]) -> np.ndarray:
        """The ids of a text's words (0: no item's)."""
        get = self.ids.get
        return np.array([get(x, 0) for x in w], np.uint64)

    def hits(self, known: np.ndarray) -> list[tuple[int, int]]:
        """(position, index of the n-gram) of every n-gram of the items in a text's words."""
        found: list[tuple[int, int]] = []
        for n in self.sizes:
            if len(known) < n:
                continue
            alive = known[: len(known) - n + 1] > 0
            for k in range(1, n):
                alive &= known[k : len(known) - n + 1 + k] > 0
            at = np.flatnonzero(alive)
            if not len(at):
                continue
            columns = np.zeros((SEED, len(at)), np.uint64)
            for k in range(n):
                columns[k] = known[at + k]
            keys = self.key(columns)
            spot = np.searchsorted(self.keys, keys)
            spot[spot == len(self.keys)] = 0
            good = self.keys[spot] == keys
            found += zip(at[good].tolist(), spot[good].tolist(), strict=True)
        return found

    def likely(self, known: np.ndarray, at: list[int], share: float) -> list[tuple[int, int, np.ndarray]]:
        """Regions (first and last hit) of a text's hits, and for each item whether it can share enough words with any stretch there.

        A stretch of an item lies within its length and a quarter around its hits, so
        what the region and such a margin around it hold of a word bounds what any
        stretch in it holds. All items are counted at once.
        """
        margin = self.longest + self.longest // 4 + SEED + 3
        out, begin = [], 0
        for k in range(1, len(at) + 1):
            if k < len(at) and at[k] - at[k - 1] <= margin:
                continue
            words, n = np.unique(known[max(0, at[begin] - margin) : at[k - 1] + margin], return_counts=True)
            n, words = n[words > 0], words[words > 0].astype(np.int64)
            size = self.first[words + 1] - self.first[words]
            spot = np.repeat(self.first[words] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            most = np.bincount(self.holder[spot], weights=np.minimum(self.times[spot], np.repeat(n, size)), minlength=len(self.lengths))
            out.append((at[begin], at[k - 1], most >= share * self.lengths))
            begin = k
        return out

    def shared(self, nr: int, part: np.ndarray) -> int:
        """Words that an item and a stretch of a text have in common; no alignment matches more."""
        ids, n = np.unique(part, return_counts=True)
        bag = self.bags[nr]
        return sum(min(k, bag[x]) for x, k in zip(ids.tolist(), n.tolist(), strict=True) if x in bag)


def passages(docs: DataFrame, items: list[tuple[int, str]], share: float) -> DataFrame:
    """doc_id, t, item_id, passage: each stretch of a text that hits an item and has at least `share` of its words.

    Where hits chain over more than six times the item's words, the stretch is cut
    into pieces of that length, each half over the next: an alignment of a positive
    score covers three times the item's words at most, so it lies whole in one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seeds = Seeds(items)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, t, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "t", "text")), strict=True):
                w = words_of(text)
                known = seeds.known(w)
                by_item: dict[int, list[tuple[int, int]]] = {}
                hits = sorted(seeds.hits(known))
                regions = iter(seeds.likely(known, [at for at, _ in hits], share) if hits else [])
                last, able = -1, np.zeros(0, bool)
                for at, spot in hits:
                    while at > last:
                        _, last, able = next(regions)
                    for nr, place in seeds.where[spot]:
                        if able[nr]:
                            by_item.setdefault(nr, []).append((at, place))
                for nr, found in by_item.items():
                    n = seeds.length[nr]
                    found.sort()
                    begin = 0
                    for k in range(1, len(found) + 1):
                        if k == len(found) or found[k][0] - found[k - 1][0] > n + SEED:  # a new stretch
                            # the item may begin as far before any hit, and end as far behind it, as the hit lies in it
                            a = max(0, min(at - place for at, place in found[begin:k]) - n // 4 - 2)
                            b = min(len(w), max(at - place for at, place in found[begin:k]) + n + n // 4 + 2)
                            for c in range(a, max(a + 1, b - 3 * n), 3 * n):
                                d = min(b, c + 6 * n)
                                if seeds.shared(nr, known[c:d]) >= share * n:
                                    out.append((doc_id, t, items[nr][0], " ".join(w[c:d])))
                            begin = k
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "t", "item_id", "passage"])

    return docs.mapInArrow(run, _PASSAGES)


def align(item: list[str], passage: list[str]) -> tuple[int, int, int]:
    """Best local alignment of two word lists: (score, matched words, aligned words of the item).

    One row of scores is held at a time, with the matched words and the beginning
    of the alignment that ends in each place.
    """
    ids: dict[str, int] = {}
    a = [ids.setdefault(w, len(ids)) for w in item]
    b = np.array([ids.setdefault(w, len(ids)) for w in passage], np.int64)
    places = np.arange(len(b) + 1, dtype=np.int64)
    score, same, begin = (np.zeros(len(b) + 1, np.int64) for _ in range(3))
    best = (0, 0, 0)
    for i, word in enumerate(a, 1):
        hit = b == word
        over, up = score[:-1] + np.where(hit, MATCH, DIFFER), score[1:] + GAP
        across = over >= up
        now, matched, began = np.zeros(len(b) + 1, np.int64), np.zeros(len(b) + 1, np.int64), np.full(len(b) + 1, i, np.int64)
        now[1:] = np.where(across, over, up)
        matched[1:] = np.where(across, same[:-1] + hit, same[1:])
        began[1:] = np.where(across, np.where(score[:-1] > 0, begin[:-1], i - 1), begin[1:])
        low = now <= 0
        now[low], matched[low], began[low] = 0, 0, i
        # gaps along the row: the running maximum of score plus the way back, with its place
        reach = np.maximum.accumulate((now - GAP * places) << 32 | places)
        spot = reach & ((1 << 32) - 1)
        score, same, begin = (reach >> 32) + GAP * places, matched[spot], began[spot]
        j = int(score.argmax())
        if score[j] > best[0]:
            best = int(score[j]), int(same[j]), i - int(begin[j])
    return best


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK, by item_id."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).filter("item_id IS NOT NULL").distinct().orderBy("item_id", "text")
    block: list[tuple[int, str]] = []
    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.5, least_words: int = 10) -> DataFrame:
    """doc_id, t (the text's hash), item_id, score, matched, n_words: documents that hold a copy of an item.

    `score`: alignment score over the best possible one of the item. A pair is
    returned if the score is `least` or more, or if `least_words` words that make
    up 40 % of the item match within the alignment and 80 % of the aligned words do.
    """
    spark = docs.sparkSession
    rows = texts(docs).withColumn("t", text_hash(F.col("text")))
    made = None
    for items in blocks_of(benchmark):
        # A score of `least` takes that share of matched words, the other bound 40 %.
        part = _judge(passages(rows, items, min(least, 0.4)), items, least, least_words)
        made = part if made is None else made.unionByName(part)
    if made is None:
        return spark.createDataFrame([], "doc_id long, t long, item_id long, score double, matched long, n_words long")
    return made


def _judge(found: DataFrame, items: list[tuple[int, str]], least: float, least_words: int) -> DataFrame:
    found = spool(found)
    # Equal passages of an item are one row with many places.
    asked = found.select("item_id", "passage").distinct()
    texts_of = {}
    for item_id, text in items:
        texts_of.setdefault(item_id, []).append(words_of(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            out = []
            for item_id, passage in zip(*(batch.column(c).to_pylist() for c in ("item_id", "passage")), strict=True):
                p = passage.split(" ")
                best = (0.0, 0, 0)
                for item in texts_of[item_id]:
                    top, same, width = align(item, p)
                    score = top / (MATCH * max(1, len(item)))
                    if score >= least or (same >= least_words and same >= 0.4 * len(item) and same >= 0.8 * width):
                        best = max(best, (score, same, len(item)))
                if best[0]:
                    out.append((item_id, passage, *best))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["item_id", "passage", "score", "matched", "n_words"])

    # Few bytes but much work: the number of tasks is set, so that they are not put together by size.
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = asked.repartition(tasks, "passage").mapInArrow(run, "item_id long, passage string, score double, matched long, n_words long")
    met = found.join(good, ["item_id", "passage"])
    return met.groupBy("doc_id", "t", "item_id").agg(F.max(F.struct("score", "matched", "n_words")).alias("m")).select("doc_id", "t", "item_id", "m.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every document that holds a copy of a benchmark item, with the alignment's score."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "matched", "n_words")
