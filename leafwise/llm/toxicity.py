"""Toxicity by multiple-instance learning (operator 11).

Labels are known for documents only. A document is a bag of sentences (a longer
one counts as several of LONG words each); a sentence's probability p is a
logistic function of the traits it holds, which are its words and the beginnings
of its words (so inflected and compound forms share theirs), and a document's is
their noisy-or, 1 - (1 - p1)(1 - p2)... Weights are learnt from document labels through
the noisy-or, so the blame falls on the sentences that explain a label; the same
weights then locate offending sentences in any document.

Bounds of the fit, the same at every input size: FIT_ROWS labelled rows chosen by
a hash of the doc_id, and the VOCABULARY traits that tell the labels apart best.
Both the counts of traits and each pass of gradient descent are Spark jobs over
those rows; a task sends one row of sums. Scoring covers every whole text and
needs no shuffle.

Defined results: a null text counts as empty; a text without sentences scores as
one empty sentence does; rows without a label, or with labels that contradict
each other, are not learnt from; without labelled rows of both kinds every score
is 0; repeated rows give repeated rows; no rows give no rows. Further columns
play no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_from, slices, spool, table, texts

FIT_ROWS = 12_000
#: Traits with weights, and rows that a trait must be in to get one; lengths of the beginnings.
VOCABULARY = 4_000
LEAST_ROWS = 5
BEGINNINGS = (4, 5, 6, 7)
LONG = 40
PASSES = 40
RIDGE = 0.1
#: Words whose traits a task remembers.
REMEMBERED = 200_000
#: Tasks that share the rows of the fit, and bytes of text taken up at once.
PARTS = 12
CHUNK = 4 << 20

SENTENCE = re.compile(r"[^.!?…。！？\n\r]+[.!?…。！？]*")
WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """start, end and distinct lower-case words of every sentence that holds a word; long ones in parts."""
    for found in SENTENCE.finditer(text):
        start, end = found.span()
        own = WORD.findall(found[0].lower())
        if len(own) <= LONG:
            if own:
                yield start, end, set(own)
            continue
        # Places are those of the text as it stands: lower-casing may change lengths.
        spans = [m.span() for m in WORD.finditer(text, start, end)]
        for at in range(0, len(spans), LONG):
            a = start if at == 0 else spans[at][0]
            b = end if at + LONG >= len(spans) else spans[at + LONG][0]
            yield a, b, set(WORD.findall(text[a:b].lower()))


def traits(word: str) -> list[str]:
    """A word between marks, and its beginnings (letters beyond the fortieth play no part)."""
    word = word[:40]
    return [f"<{word}>", *(f"<{word[:n]}" for n in BEGINNINGS if len(word) > n)]


def known_traits(number: dict[str, int]) -> Callable[[set[str]], set[int]]:
    """The function that gives the numbers of the traits of a sentence's words; what single words have is remembered."""
    held: dict[str, tuple[int, ...]] = {}

    def known(words: set[str]) -> set[int]:
        out: set[int] = set()
        for w in words:
            own = held.get(w)
            if own is None:
                own = tuple(number[x] for x in traits(w) if x in number)
                if len(held) >= REMEMBERED:
                    held.clear()
                held[w] = own
            if own:
                out.update(own)
        return out

    return known


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """label, text of the rows to learn from, read once and written; the chosen ids are bounded by FIT_ROWS, so they are broadcast."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out).groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("other")).filter("label = other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("doc_id", "label")
    met = texts(docs).join(F.broadcast(chosen), "doc_id")
    return spool(met.select("label", "text").repartition(PARTS))


def telling_traits(rows: DataFrame) -> list[str]:
    """The VOCABULARY traits whose share of rows differs most between the labels, by the z value of their log odds."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                counts: dict[str, list[int]] = {}
                for label, text in zip(part.column("label").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for x in {x for w in set(WORD.findall(text.lower())) for x in traits(w)}:
                        counts.setdefault(x, [0, 0])[label > 0] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["trait", "no", "yes"])

    total = rows.agg(F.count_if(F.col("label") == 0).alias("no"), F.count_if(F.col("label") > 0).alias("yes")).first()
    if not total["no"] or not total["yes"]:
        return []
    counted = rows.mapInArrow(held, "trait string, no long, yes long").groupBy("trait").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).filter(F.col("no") + F.col("yes") >= LEAST_ROWS)
    odds = F.log((F.col("yes") + 0.5) / (total["yes"] - F.col("yes") + 0.5)) - F.log((F.col("no") + 0.5) / (total["no"] - F.col("no") + 0.5))
    z = odds / F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    return sorted(r["trait"] for r in counted.orderBy(F.abs(z).desc(), "trait").limit(VOCABULARY).select("trait").collect())


def bags(rows: DataFrame, chosen: list[str]) -> DataFrame:
    """label, n (sentences), at, trait of every row: trait numbers and the sentences they are in."""
    number = {x: i for i, x in enumerate(chosen)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_traits(number)
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                made = []
                for text in part.column("text").to_pylist():
                    at, held, n = [], [], 0
                    for n, (_, _, own) in enumerate(sentences(text), 1):
                        some = sorted(known(own))
                        at += [n - 1] * len(some)
                        held += some
                    made.append((max(n, 1), at, held))
                columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([part.column("label"), *columns], names=["label", "n", "at", "trait"])

    return spool(rows.mapInArrow(cut, "label int, n long, at array<int>, trait array<int>"))


def noisy_or_sums(label: np.ndarray, n: np.ndarray, doc: np.ndarray, sentence: np.ndarray, trait: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loss and gradient (constant last) of bags under `weights`; sentence numbers run on over the bags, `doc` has the bag of each sentence with traits."""
    z = weights[-1] + np.bincount(sentence, weights=weights[trait], minlength=len(doc))
    own, plain = np.logaddexp(0, z), np.logaddexp(0, weights[-1])  # -log of 1 - p
    bare = n - np.bincount(doc, minlength=len(n))
    none = np.bincount(doc, weights=own, minlength=len(n)) + bare * plain  # -log that no sentence offends
    none = np.maximum(none, 1e-12)
    loss = np.where(label > 0, -np.log(-np.expm1(-none)), none)
    # d loss / d z of a sentence is its p, times this:
    pull = np.where(label > 0, -1 / np.expm1(np.minimum(none, 700)), 1.0)
    p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-weights[-1]))
    slope = p * pull[doc]
    out = np.zeros(len(weights) + 1)
    out[:-2] = np.bincount(trait, weights=slope[sentence], minlength=len(weights) - 1)
    out[-2] = slope.sum() + (pull * bare * p0).sum()
    out[-1] = loss.sum()
    return out


def sums(held: DataFrame, weights: np.ndarray) -> np.ndarray:
    """noisy_or_sums over all bags: each task adds up its own and sends one row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights) + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, trait = batch.column("at"), batch.column("trait").flatten().to_numpy(zero_copy_only=False)
            bag = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
            place = at.flatten().to_numpy(zero_copy_only=False)
            fresh = np.ones(len(place), bool)
            fresh[1:] = (bag[1:] != bag[:-1]) | (place[1:] != place[:-1])
            total += noisy_or_sums(batch.column("label").to_numpy(), batch.column("n").to_numpy(), bag[fresh], np.cumsum(fresh) - 1, trait, weights)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return sum((np.frombuffer(r["sums"]) for r in held.mapInArrow(add, "sums binary").collect()), np.zeros(len(weights) + 1))  # PARTS rows


@dataclass
class Model:
    """Weights of traits and the constant; without traits (nothing to learn from) all scores are 0."""

    weights: dict[str, float]
    constant: float

    def judge(self) -> Callable[[str], tuple[float, list[tuple[int, int, float]]]]:
        """The function that gives a document's score, and start, end and score of each of its sentences."""
        if not self.weights:
            return lambda text: (0.0, [(a, b, 0.0) for a, b, _ in sentences(text)])
        known, weight, constant = known_traits({x: i for i, x in enumerate(self.weights)}), list(self.weights.values()), self.constant
        plain, bare = math.log1p(math.exp(constant)), 1 / (1 + math.exp(-constant))

        def judged(text: str) -> tuple[float, list[tuple[int, int, float]]]:
            found, none = [], 0.0
            for start, end, own in sentences(text):
                some = known(own)
                if not some:
                    none += plain
                    found.append((start, end, bare))
                    continue
                z = constant + math.fsum(weight[i] for i in some)
                none += max(z, 0.0) + math.log1p(math.exp(-abs(z)))
                found.append((start, end, 1 / (1 + math.exp(-z)) if z > -700 else 0.0))
            return -math.expm1(-(none if found else plain)), found

        return judged


def train(docs: DataFrame, labels: DataFrame, held_out: Column) -> Model:
    """Weights learnt from the labelled rows that are not held out: signs of the gradient with a step of its own for each weight."""
    rows = labelled(docs, labels, held_out)
    chosen = telling_traits(rows)
    if not chosen:
        return Model({}, -math.inf)
    held = bags(rows, chosen)
    share = held.agg(F.sum("n").alias("n"), F.count_if(F.col("label") > 0).alias("yes")).first()
    weights = np.zeros(len(chosen) + 1)
    weights[-1] = math.log(share["yes"] / share["n"]) - 1
    step, before, least, best = np.full(len(weights), 0.3), np.zeros(len(weights)), math.inf, weights
    for _ in range(PASSES):
        got = sums(held, weights)
        slope, loss = got[:-1].copy(), got[-1] + RIDGE / 2 * (weights[:-1] ** 2).sum()
        slope[:-1] += RIDGE * weights[:-1]
        if loss < least:
            least, best = loss, weights
        turned = slope * before
        step = np.clip(np.where(turned > 0, step * 1.2, np.where(turned < 0, step * 0.5, step)), 1e-6, 1.0)
        before = np.where(turned < 0, 0, slope)
        weights = weights - np.sign(before) * step
    return Model({x: float(v) for x, v in zip(chosen, best, strict=False)}, float(best[-1]))


def held_out_rows(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the doc_id as text can be divided by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, offending of every text under `model`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.judge()
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                made = [judge(t) for t in part.column("text").to_pylist()]
                spans = [[{"start": a, "end": b, "score": p} for a, b, p in found if p >= 0.5] for _, found in made]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s for s, _ in made], pa.float64()), pa.array(spans, SPANS)], names=["doc_id", "score", "offending"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, offending: the score of every whole text, and the spans (code points, end exclusive) and scores of its sentences that are likelier toxic than not."""
    return scored(docs, train(docs, labels, held_out_rows()))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, whether its row was held out, and how many of its sentences offend."""

    def made() -> DataFrame:
        found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
        return found.select("doc_id", held_out_rows().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))

    return kept_from(spark, made)
