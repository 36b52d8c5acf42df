"""Importance resampling towards a target distribution (operator 13).

Features are the runs of one to three words of a text, hashed into BUCKETS. What
the corpus and the target texts hold of each bucket gives an array of gains; a
text's weight is the sum of its features' gains. Perturbed by Gumbel noise that
depends on the doc_id alone, the highest scores are a draw without replacement.

The draw: each partition's eligible rows become sorted runs, cut into blocks and
at splitters of the score; blocks are dealt out by range and come in the order
of their first rows, and a tournament tree over the open blocks merges them. A
range knows by the counts of those before how many rows it has to give, so it
stops there; ranges behind the last draw are never merged.

Defined results: a null text counts as empty; an empty text, like one without
words, has weight 0; the noise of a null doc_id is that of `42:`, and in ties it
comes after all others; rows that share a doc_id are drawn one by one; without
target texts the gains only say what is rare in the corpus; an empty table has
no rows. Further columns play no part.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_from, slices, spool, table, texts

BUCKETS = 10_000
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
#: Bytes of text that are hashed at once; rows of a run and of a block; rows of a range, ranges and sampled rows at most.
CHUNK = 1 << 20
RUN_ROWS = 1 << 18
BLOCK_ROWS = 512
RANGE_ROWS = 10_000
RANGES = 2_000
SAMPLE = 40_000
#: Words up to so many bytes are hashed side by side, longer ones one by one.
SHORT = 64
LAST = (1 << 63) - 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of CRC-32 for one byte, and what 0 to SHORT zero bytes make of each byte of a CRC."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    far = np.empty((SHORT + 1, 4, 256), np.uint32)
    far[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32)[:, None] * 8)
    for n in range(SHORT):
        far[n + 1] = one[far[n] & 255] ^ (far[n] >> 8)
    return one, far.reshape(-1)


ONE, FAR = _tables()
_BYTES = np.arange(256)
LOWERED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IN_WORD = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122))


def _then(crc: np.ndarray, more: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRCs of texts with CRC `crc`, each followed by one with CRC `more` of `sizes` bytes (up to SHORT)."""
    at = sizes.astype(np.int64) * 1024
    return FAR[at + (crc & 255)] ^ FAR[at + 256 + ((crc >> 8) & 255)] ^ FAR[at + 512 + ((crc >> 16) & 255)] ^ FAR[at + 768 + (crc >> 24)] ^ more


def _spaced(crc: np.ndarray) -> np.ndarray:
    """The CRCs of the texts with a space behind."""
    state = ~crc
    return ~(ONE[(state ^ 32) & 255] ^ (state >> 8))


def features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text (index into raw) and bucket of every feature, and the number of words of each text."""
    joined = LOWERED[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    inside = IN_WORD[joined]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[0::2], edges[1::2]
    size = ends - starts
    bounds = np.cumsum([len(r) + 1 for r in raw])
    text = np.searchsorted(bounds, starts, side="right")
    # Words by falling size: those with a byte left are always the first ones.
    order = np.argsort(-np.minimum(size, SHORT), kind="stable")
    at, left = starts[order], np.minimum(size, SHORT)[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    n = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
    for j, m in enumerate(n.tolist()):
        head = state[:m]
        state[:m] = ONE[(head ^ joined[at[:m] + j]) & 255] ^ (head >> 8)
    word = np.empty_like(state)
    word[order] = ~state
    long = np.flatnonzero(size > SHORT)
    whole = {i: joined[starts[i] : ends[i]].tobytes() for i in long.tolist()}
    for i, w in whole.items():
        word[i] = zlib.crc32(w)

    def longer(crc: np.ndarray, by: int) -> np.ndarray:
        """CRCs of the runs that begin like those of `crc` and have the word `by` places on behind."""
        made = _then(_spaced(crc[: len(word) - by]), word[by:], np.minimum(size[by:], SHORT))
        for i, w in whole.items():
            if i >= by:
                made[i - by] = zlib.crc32(w, int(_spaced(crc[i - by : i - by + 1])[0]))
        return made

    if len(word) < 2:
        return text, word % BUCKETS, np.bincount(text, minlength=len(raw))
    pairs = longer(word, 1)
    threes = longer(pairs, 2) if len(word) > 2 else pairs[:0]
    in_two, in_three = text[1:] == text[:-1], text[2:] == text[:-2]
    crc = np.concatenate([word, pairs[in_two], threes[in_three]])
    return np.concatenate([text, text[:-1][in_two], text[:-2][in_three]]), crc % BUCKETS, np.bincount(text, minlength=len(raw))


def pieces(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """A long text in pieces that end at a word's end, each with the two words before it: features of those alone are to be taken off."""
    start, context = 0, b""
    inside = IN_WORD[LOWERED]
    while start < len(raw):
        end = min(start + CHUNK, len(raw))
        while end < len(raw) and inside[raw[end]]:
            end += 1
        piece = context + raw[start:end]
        yield piece, context
        flags = inside[np.frombuffer(piece, np.uint8)]
        edges = np.flatnonzero(np.diff(flags, prepend=False, append=False))
        last = edges[-4:] if len(edges) >= 4 else edges
        context = b"".join(piece[a:b] + b" " for a, b in zip(last[0::2].tolist(), last[1::2].tolist(), strict=True))
        start = end


def by_text(values: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """first index, text, bucket and sign of the features of texts in groups of about CHUNK bytes, for texts of any length."""
    group: list[bytes] = []
    first = held = 0

    def whole() -> tuple:
        text, bucket, words = features(group)
        return first, text, bucket, np.ones(len(text), np.int64), words

    for i, value in enumerate(values):
        raw = value.encode()
        if group and held + len(raw) > CHUNK:
            yield whole()
            group, held, first = [], 0, i
        if len(raw) > CHUNK:
            for piece, context in pieces(raw):
                text, bucket, words = features([piece])
                again, less, before = features([context])
                yield i, np.zeros(len(text) + len(again), np.int64), np.concatenate([bucket, less]), np.concatenate([np.ones(len(text), np.int64), np.full(len(again), -1)]), words - before
            first = i + 1
            continue
        group.append(raw)
        held += len(raw)
    if group:
        yield whole()


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features of `text` fall into each bucket; a task sends BUCKETS rows at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 4 * CHUNK):
                for _, _, bucket, sign, _ in by_text(part.column("text").to_pylist()):
                    held += np.bincount(bucket, weights=sign, minlength=BUCKETS).astype(np.int64)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["bucket", "n"])

    counted = rows.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in counted.collect():  # BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight."""
    every, wanted = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * every / ((s + 1.0) * wanted))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None) -> int:
    """Gumbel noise in thousandths, from the doc_id alone."""
    h = int(sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row of `docs` (doc_id, text)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 * CHUNK):
                n = part.num_rows
                words, count, weight = (np.zeros(n, np.int64) for _ in range(3))
                for first, text, bucket, sign, n_words in by_text(part.column("text").to_pylist()):
                    words[first : first + len(n_words)] += n_words
                    np.add(count[first : first + len(n_words)], np.bincount(text, weights=sign, minlength=len(n_words)).astype(np.int64), out=count[first : first + len(n_words)])
                    np.add(weight[first : first + len(n_words)], np.rint(np.bincount(text, weights=gain[bucket] * sign, minlength=len(n_words))).astype(np.int64), out=weight[first : first + len(n_words)])
                score = weight + np.array([noise(d) for d in part.column("doc_id").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (words, count, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long")


class Tournament:
    """A tournament tree: each inner place holds the winner, the least key, of the two below it."""

    def __init__(self) -> None:
        self.size = 1
        self.key: list = [None]
        self.best = [0, 0]
        self.free = [0]

    def _grow(self) -> None:
        keys, self.size = self.key, 2 * self.size
        self.key = keys + [None] * len(keys)
        self.free = list(range(self.size - 1, len(keys) - 1, -1))
        self.best = [0] * self.size + list(range(self.size))
        for at in range(self.size - 1, 0, -1):
            self.best[at] = self._winner(self.best[2 * at], self.best[2 * at + 1])

    def _winner(self, a: int, b: int) -> int:
        x, y = self.key[a], self.key[b]
        return b if x is None or (y is not None and y < x) else a

    def enter(self, key: tuple) -> int:
        """Give a new player a place."""
        if not self.free:
            self._grow()
        at = self.free.pop()
        self.play(at, key)
        return at

    def play(self, player: int, key: tuple | None) -> None:
        """A player's next key (None: it leaves); its matches up to the root are played again."""
        self.key[player] = key
        if key is None:
            self.free.append(player)
        if self.size == 1:
            return
        at = (self.size + player) // 2
        while at:
            self.best[at] = self._winner(self.best[2 * at], self.best[2 * at + 1])
            at //= 2

    def winner(self) -> tuple[int, tuple] | None:
        player = self.best[1] if self.size > 1 else 0
        return None if self.key[player] is None else (player, self.key[player])


def merge(blocks: Iterator[np.ndarray], take: int) -> Iterator[int]:
    """The rows of the first `take` entries of sorted blocks (columns: negated score, doc_id, row), which come by their first entries.

    A block is opened when no open one holds an earlier entry, so no more are
    open at a time than overlap.
    """
    tree = Tournament()
    open_: dict[int, list] = {}
    coming = next(blocks, None)
    while take > 0:
        best = tree.winner()
        while coming is not None and (best is None or tuple(coming[:, 0].tolist()) <= best[1]):
            held = list(zip(*coming.tolist(), strict=True))[::-1]
            player = tree.enter(held.pop())
            open_[player] = held
            coming, best = next(blocks, None), tree.winner()
        if best is None:
            return
        player, key = best
        yield key[2]
        take -= 1
        held = open_[player]
        tree.play(player, held.pop() if held else None)


def runs(rows: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    """part, n, a, b, c, body: blocks of sorted runs of `rows` (row, doc_id, score), cut at `cuts`; (a, b, c) is a block's first entry."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            entries = np.concatenate(held, axis=1)
            entries = entries[:, np.lexsort(entries[::-1])]
            lows = [0, *(bisect_right(range(entries.shape[1]), c, key=lambda i: tuple(entries[:, i].tolist())) for c in cuts), entries.shape[1]]
            made = [(part, at, min(at + BLOCK_ROWS, high)) for part, (low, high) in enumerate(zip(lows, lows[1:], strict=False)) for at in range(low, high, BLOCK_ROWS)]
            for at in range(0, len(made), 64):
                some = made[at : at + 64]
                head = entries[:, [i for _, i, _ in some]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _, _ in some], pa.int32()), pa.array([j - i for _, i, j in some], pa.int64()), *map(pa.array, head), pa.array([np.ascontiguousarray(entries[:, i:j]).tobytes() for _, i, j in some], pa.binary())],
                    names=["part", "n", "a", "b", "c", "body"],
                )

        count = 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(LAST).to_numpy()
            held.append(np.stack([-batch.column("score").to_numpy(), ids, batch.column("row").to_numpy()]))
            count += batch.num_rows
            if count >= RUN_ROWS:
                yield from out()
                held, count = [], 0
        if count:
            yield from out()

    return rows.select("row", "doc_id", "score").mapInArrow(sort, "part int, n long, a long, b long, c long, body binary")


def drawn(scored: DataFrame, count: int, total: int) -> DataFrame:
    """row, rank of the `count` highest of the `total` rows of `scored` (row, doc_id, score); ties to the smaller doc_id."""
    spark = scored.sparkSession
    ranges = min(RANGES, -(-total // RANGE_ROWS))
    cuts: list[tuple[int, int, int]] = []
    if ranges > 1:
        # A bounded sample of entries, for the splitters only.
        step = max(1, -(-total // SAMPLE))
        sample = scored.filter(F.pmod(F.xxhash64("row"), F.lit(step)) == 0).select(-F.col("score"), F.coalesce("doc_id", F.lit(LAST)), "row")
        seen = heapq.nsmallest(2 * SAMPLE, (tuple(r) for r in sample.toLocalIterator()))
        cuts = sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []
    blocks = spool(runs(scored, cuts))
    sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # RANGES rows
    wanted: dict[int, tuple[int, int]] = {}
    before = 0
    for part in sorted(sizes):
        if before < count:
            wanted[part] = (before, min(sizes[part], count - before))
        before += sizes[part]
    last = max(wanted, default=-1)

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                for part, body in zip(batch.column("part").to_pylist(), batch.column("body"), strict=True):
                    yield part, np.frombuffer(body.as_buffer(), np.int64).reshape(3, -1)

        coming = entries()
        ahead = next(coming, None)
        while ahead is not None:
            part = ahead[0]

            def own(part: int = part) -> Iterator[np.ndarray]:
                nonlocal ahead
                while ahead is not None and ahead[0] == part:
                    yield ahead[1]
                    ahead = next(coming, None)

            source, (rank, take) = own(), wanted[part]
            got: list[int] = []
            for row in merge(source, take):
                got.append(row)
                if len(got) == RUN_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(range(rank + 1, rank + 1 + len(got)), pa.int64())], names=["row", "rank"])
                    rank, got = rank + len(got), []
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(range(rank + 1, rank + 1 + len(got)), pa.int64())], names=["row", "rank"])
            for _ in source:  # what lies behind the last draw
                pass

    dealt = blocks.filter(F.col("part") <= last).repartition(F.col("part")).sortWithinPartitions("part", "a", "b", "c")
    return spark.createDataFrame([], "row long, rank long") if last < 0 else dealt.select("part", "body").mapInArrow(play, "row long, rank long")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of `docs` (doc_id, text); rank is null where it was not drawn."""
    corpus, wanted = texts(docs), target.select(F.coalesce("text", F.lit("")).alias("text"))
    gain = gains(bucket_counts(corpus), bucket_counts(wanted))
    scored = spool(weighted(corpus, gain).withColumn("row", F.monotonically_increasing_id()))
    eligible = scored.filter(F.col("n_words") >= least_words)
    total = eligible.count()
    ranks = drawn(eligible, percent * total // 100, total)
    return scored.join(ranks, "row", "left").drop("row")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document for a draw towards the benchmark's texts."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return kept_from(spark, lambda: resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank"))


#: The same in DuckDB SQL; the CRC of each distinct feature is folded byte by byte.
ORACLE = rf"""WITH tab AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_concat([CAST(b AS UBIGINT)], [CAST(0 AS UBIGINT) FOR k IN range(8)]), lambda x, k: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1))) AS c FROM range(256) r(b))),
texts AS (SELECT 'd' AS kind, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT kind, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
word AS (SELECT kind, row, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM words),
ahead AS (SELECT kind, row, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY kind, row ORDER BY i)),
feature AS (SELECT kind, row, w AS f FROM ahead UNION ALL SELECT kind, row, w || ' ' || w2 FROM ahead WHERE w2 IS NOT NULL UNION ALL SELECT kind, row, w || ' ' || w2 || ' ' || w3 FROM ahead WHERE w3 IS NOT NULL),
counted AS (SELECT kind, row, f, count(*) AS n FROM feature GROUP BY ALL),
hashed AS (SELECT f, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(range(1, CAST(length(x) AS BIGINT), 2), lambda i: CAST(('0x' || substr(x, i, 2)) AS UBIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) + 1 AS BIGINT)])), CAST(4294967295 AS UBIGINT)) % {BUCKETS} AS bucket
  FROM (SELECT DISTINCT f, hex(encode(f)) AS x FROM counted), tab),
placed AS (SELECT kind, row, bucket, n FROM counted JOIN hashed USING (f)),
held AS (SELECT bucket, CAST(sum(CASE WHEN kind = 'd' THEN n ELSE 0 END) AS DOUBLE) AS s, CAST(sum(CASE WHEN kind = 'b' THEN n ELSE 0 END) AS DOUBLE) AS t FROM placed GROUP BY bucket),
every AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM held),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS})))) AS BIGINT) AS g FROM held, every),
weights AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM placed JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY row),
noised AS (SELECT row, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS UBIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (row) WHERE kind = 'd'),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS eligible FROM noised WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * eligible // 100 THEN rank END AS rank FROM noised LEFT JOIN ranked USING (row)"""
