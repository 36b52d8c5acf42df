"""Quality classifier by compression (operator 6).

Two zstandard dictionaries are built, one from good and one from bad labelled
text. A text is cut into pieces of PIECE bytes; each piece is compressed with
either dictionary, and the difference of the two sizes over the raw size tells
which kind of text it resembles. A text's features are the mean and the extremes
of that difference over its pieces, and the same of the compressed size itself;
a logistic curve fitted to labelled rows turns them into a score.

Bounds of the fit, the same at every input size: FIT_ROWS labelled rows for the
curve and, of their texts, PIECES pieces for each dictionary, chosen by hashes. Scoring covers every whole text and needs no shuffle.

Defined results: a null text counts as empty; an empty text has all features
zero and is scored like any other; rows without a label, or with labels that
contradict each other, are not learnt from; without labelled rows of both kinds
every score is 0.5; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, map_texts, table, texts

PIECE = 1024
PIECES = 6000
FIT_ROWS = 12_000
DICTIONARY = 64 << 10
LEVEL = 1
#: Size of an empty frame, subtracted from each piece's.
FRAME = 9


@lru_cache(4)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_dict_id=False, write_content_size=False)


def features(text: str, good: bytes, bad: bytes) -> list[float]:
    """Mean, least and greatest of the size difference and of the size, per raw byte; and the squares of the means."""
    raw = text.encode()
    if not raw:
        return [0.0] * 8
    a, b = compressor(good).compress, compressor(bad).compress
    n = max(1, round(len(raw) / PIECE))  # pieces of nearly equal size: no short rest
    cuts = np.linspace(0, len(raw), n + 1).astype(int).tolist()
    view = memoryview(raw)
    size = np.array([(len(a(view[i:j])), len(b(view[i:j])), j - i) for i, j in zip(cuts, cuts[1:], strict=False)], float)
    size[:, :2] -= FRAME
    diff, both = (size[:, 1] - size[:, 0]) / size[:, 2], (size[:, 1] + size[:, 0]) / size[:, 2]
    mean, level = (size[:, 1] - size[:, 0]).sum() / len(raw), size[:, :2].sum() / len(raw)
    return [mean, diff.min(), diff.max(), level, both.min(), both.max(), mean * mean, level * level]


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, text, label: FIT_ROWS rows to learn from at most, chosen by a hash of the doc_id, one label for each doc_id.

    The chosen ids are bounded by FIT_ROWS, so they are broadcast; the texts of other rows move nowhere.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).filter("label = other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("doc_id", "label")
    return texts(docs).join(F.broadcast(chosen), "doc_id")


def dictionaries(rows: DataFrame) -> tuple[bytes, bytes] | None:
    """The dictionaries of good and bad text, from PIECES pieces of either."""

    def cut(batches):
        let_go()
        for batch in batches:
            out = [(d, i, y, raw[at : at + PIECE]) for d, y, raw in zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), (t.encode() for t in batch.column("text").to_pylist()), strict=True) for i, at in enumerate(range(0, len(raw), PIECE))]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["doc_id", "nr", "label", "piece"])

    pieces = rows.mapInArrow(cut, "doc_id long, nr int, label int, piece binary")
    made = []
    for label in (1, 0):
        # A top-k by hash: each task keeps PIECES at most.
        held = pieces.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id", "nr"), "doc_id", "nr").limit(PIECES)
        samples = [bytes(r["piece"]) for r in held.select("piece").collect()]
        if not samples:
            return None
        samples *= max(1, 64 // len(samples))
        most = min(DICTIONARY, max(1024, sum(map(len, samples)) // 4))
        try:
            made.append(zstandard.train_dictionary(most, samples, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too little text for a trained one: the text itself
            made.append(b"".join(samples)[:DICTIONARY].ljust(8, b" "))
    return made[0], made[1]


def fit(rows: np.ndarray, labels: np.ndarray, *, ridge: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the constant last) of a logistic curve: Newton steps, halved until the loss falls."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = np.hstack([(rows - mean) / scale, np.ones((len(rows), 1))])
    loss = lambda w: np.logaddexp(0, np.where(labels > 0, -1, 1) * (x @ w)).sum() + ridge / 2 * w @ w
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (labels - p) - ridge * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame, held_out: Column) -> Callable[[str], float]:
    """The scoring function of a text, learnt from labelled rows that are not held out."""
    rows = labelled(docs, labels, held_out)
    made = dictionaries(rows)
    if made is None:
        return lambda text: 0.5
    good, bad = made
    chosen = rows.withColumn("text", F.concat_ws(" ", F.col("label").cast("string"), "text"))

    def start() -> Callable[[str], tuple]:
        let_go()
        return lambda text: (int(text[0]), features(text[2:], good, bad))

    seen = map_texts(chosen, start, "doc_id long, label long, x array<double>").orderBy("doc_id").limit(2 * FIT_ROWS).collect()
    x, y = np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen], float)
    if len(set(y.tolist())) < 2:
        return lambda text: 0.5
    mean, scale, w = fit(x, y)

    def score(text: str) -> float:
        z = float(((np.array(features(text, good, bad)) - mean) / scale) @ w[:-1] + w[-1])
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))

    return score


def held_out_rows(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) of every whole text."""
    score = train(docs, labels, held_out_rows())
    return map_texts(texts(docs), lambda: lambda text: (score(text),), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, *, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose text scores `least` or more; no shuffle of the texts."""
    score = train(docs, labels, held_out_rows())

    @F.pandas_udf("double")
    def judge(text):
        let_go()
        return text.map(lambda t: score(t or ""))

    return docs.filter(judge("text") >= least)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, and whether its row was held out."""
    found = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out_rows().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
