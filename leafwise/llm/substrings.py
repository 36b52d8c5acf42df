"""Exact substring removal with a sparse suffix array (operator 7).

A byte goes if a string of MATCH bytes over it also starts in a document with a
smaller doc_id. Sorting a suffix for every byte would move fifty times the
corpus, so suffixes are sampled where their content says so: of the GRAM-byte
grams within each window of MATCH bytes, the one with the least hash is the
window's anchor. Equal windows have equal anchors at equal places, so it is
enough to bring equal anchors together; nothing is lost.

1. Texts are packed in batches and written as a table bucketed by batch. A batch
   also holds a few sampled suffixes' leading bytes.
2. The samples give splitters; anchors' suffixes are range partitioned by their
   leading bytes (then by the gram's hash, so one frequent beginning is spread).
   There is a range for each RANGE_BYTES of text, whatever the corpus. Six bytes
   an anchor are sent; a range sorts its share and answers with one bit for each:
   whether the gram occurs again. This only rules suffixes out.
3. Anchors that do send the text of their windows, one for each distinct text in
   a batch and from its smallest doc_id; further documents with the same text in
   the batch are known to be covered. A range sorts the suffixes that begin at
   its anchors by multikey quicksort, eight bytes at a time, and compares
   neighbours byte by byte; so it does with what stands before the anchors, read
   backwards. Two windows are equal if their anchors stand in one run of equal
   suffixes and in one run of equal beginnings. Suffixes of equal anchors never
   lie on two sides of a splitter, as the splitters cut between grams.
4. Covered stretches go back to their batch, where bytes are taken out.

The bucketed table is read where it lies in steps 3 and 4: texts are never
shuffled. Frequent passages are summed up in each batch before they are sent.

Defined results: a null text counts as empty; texts shorter than MATCH keep all
bytes; rows that share a doc_id do not cover each other; a null doc_id counts as
the largest; repeated rows give repeated rows; texts of any length are read
whole; further columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_from, slices, table, texts

MATCH = 50
GRAM = 24
SPAN = MATCH - GRAM + 1  # grams in a window
WIDE = MATCH + SPAN - 1  # bytes of the windows of one anchor, at most
BATCH_BYTES = 6 << 20
CHUNK = 1 << 19
#: Bytes of text for each range of suffixes.
RANGE_BYTES = 12 << 20
SAMPLES = 64
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as little-endian numbers, without a copy."""
    return np.ndarray((max(0, len(buf) - 7),), "<u8", buf, strides=(1,))


def gram_hash(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    v, n = eight(buf), len(buf) - GRAM + 1
    h = v[:n] * A
    for k in (8, 16):
        h ^= h >> np.uint64(32)
        h += v[k : k + n]
        h *= B
    h ^= h >> np.uint64(29)
    h *= C
    h ^= h >> np.uint64(32)
    return h


def lead_key(leads: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The order of suffixes: five leading bytes, then the gram's hash."""
    return (leads.byteswap() >> np.uint64(24) << np.uint64(24)) | (hashes >> np.uint64(40))


class Batch:
    """Texts laid end to end, and the anchors of their windows."""

    def __init__(self, blob: bytes, ends: np.ndarray) -> None:
        self.buf = np.frombuffer(blob, np.uint8)
        self.ends = ends
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, number of windows, gram's hash, order key, anchor's place from the first window) of each run of windows that share an anchor."""
        size = len(self.buf) - MATCH + 1
        empty = np.zeros(0, np.int64)
        if size <= 0:
            return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty
        long = self.ends - self.starts >= MATCH
        edge = np.zeros(len(self.buf) + 1, np.int8)
        edge[self.starts[long]] += 1
        edge[self.ends[long] - MATCH + 1] -= 1
        valid = np.cumsum(edge[:size], dtype=np.int8) > 0
        made = []
        for c in range(0, size, CHUNK):
            upto = min(size, c + CHUNK)
            part = self.buf[c : upto + MATCH - 1]
            h = gram_hash(part)
            low = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while 2 * width <= SPAN:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            low = np.minimum(low[: upto - c], low[SPAN - width : SPAN - width + upto - c])
            at = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
            at[~valid[c:upto]] = -1
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            count = np.diff(np.concatenate([first, [len(at)]]))
            keep = at[first] >= 0
            first, count, at = first[keep], count[keep], at[first[keep]]
            made.append((first + c, count, h[at], lead_key(eight(part)[at], h[at]), at - first))
        return tuple(np.concatenate(x) for x in zip(*made, strict=True))

    def context(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The bytes of runs of windows, a row each, zero behind their end."""
        padded = np.concatenate([self.buf, np.zeros(80, np.uint8)])
        rows = padded[first[:, None] + np.arange(80)]
        rows[np.arange(80) >= (count + MATCH - 1)[:, None]] = 0
        return rows


def row_hash(rows: np.ndarray, count: np.ndarray) -> np.ndarray:
    h = count.astype(np.uint64) * A
    for column in rows.view("<u8").T:
        h = (h ^ column) * B
        h ^= h >> np.uint64(31)
    return h


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of byte strings of one width: their sorted order, and the bytes that each shares with the one before it.

    A multikey quicksort, vectorised: all strings are sorted by eight bytes, then
    those that are still equal by the next eight, and so on.
    """
    n, width = rows.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    new = np.concatenate([[True], words[order[1:], 0] != words[order[:-1], 0]])
    for k in range(1, words.shape[1]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = words[order[at], k]
        run = np.cumsum(new)[at]
        inner = np.lexsort((own, run))
        order[at] = order[at[inner]]
        own = own[inner]
        new[at[1:]] |= (own[1:] != own[:-1]) & ~new[at[1:]]
    lcp = np.zeros(n, np.int64)
    for c in range(0, n, 1 << 16):
        begin, stop = max(1, c), min(n, c + (1 << 16))
        differ = rows[order[begin:stop]] != rows[order[begin - 1 : stop - 1]]
        lcp[begin:stop] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, lcp


def covered_windows(rows: np.ndarray, lead: np.ndarray, count: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """A row for each anchor, a column for each of its windows: whether a smaller document has the same window.

    `rows`: the bytes of an anchor's windows, zero behind their end; `lead`: where
    in them the anchor begins; `count`: its number of windows.
    """
    n = len(rows)
    after, before = np.zeros((n, MATCH), np.uint8), np.zeros((n, SPAN - 1), np.uint8)
    for c in range(0, n, 1 << 14):
        part, at = rows[c : c + (1 << 14)], lead[c : c + (1 << 14), None]
        padded = np.concatenate([part, np.zeros((len(part), MATCH), np.uint8)], axis=1)
        after[c : c + (1 << 14)] = np.take_along_axis(padded, at + np.arange(MATCH), axis=1)
        back = at - 1 - np.arange(SPAN - 1)
        before[c : c + (1 << 14)] = np.where(back >= 0, np.take_along_axis(padded, np.maximum(back, 0), axis=1), 0)
    (order_a, lcp_a), (order_b, lcp_b) = suffix_order(after), suffix_order(before)
    run = np.zeros((2, n), np.int64)
    out = np.zeros((n, SPAN), bool)
    for o in range(SPAN):  # windows with o bytes before the anchor
        own = np.flatnonzero((o <= lead) & (o > lead - count))
        if len(own) < 2:
            continue
        run[0, order_a] = np.cumsum(lcp_a < MATCH - o)
        run[1, order_b] = np.cumsum(lcp_b < o)
        key = run[0, own] * (n + 1) + run[1, own]
        order = np.lexsort((docs[own], key))
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        least = docs[own][order][np.flatnonzero(new)][np.cumsum(new) - 1]
        late = own[order][docs[own][order] > least]
        out[late, lead[late] - o] = True
    return out


def batches_of(docs: DataFrame) -> DataFrame:
    """batch, doc_ids, ends, body (compressed texts), samples: `docs` packed, one row for about BATCH_BYTES of text."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            raw = b"".join(t for _, _, t in held)
            buf = np.frombuffer(raw, np.uint8)
            ends = np.cumsum([len(t) for _, _, t in held]).astype(np.int64)
            h = gram_hash(buf) if len(buf) < 4096 else None
            places = np.linspace(0, max(0, len(buf) - GRAM), SAMPLES).astype(int) if len(buf) >= GRAM else np.zeros(0, int)
            picks = [int(lead_key(eight(buf[p : p + GRAM])[:1], gram_hash(buf[p : p + GRAM]) if h is None else h[p : p + 1])[0] >> np.uint64(1)) for p in places]
            columns = [[held[0][0]], [[d for _, d, _ in held]], [ends.tolist()], [zstandard.ZstdCompressor(level=1).compress(raw)], [picks]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["batch", "doc_ids", "ends", "body", "samples"])

        for whole in given:
            for part in slices(whole, "text", BATCH_BYTES):
                for row, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                    raw = text.encode()
                    if held and size + len(raw) > BATCH_BYTES:
                        yield flush()
                        held, size = [], 0
                    held.append((row, doc_id, raw))
                    size += len(raw)
        if held:
            yield flush()

    rows = texts(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, "batch long, doc_ids array<long>, ends array<long>, body binary, samples array<long>")


def _opened(given: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch number, Batch, doc_ids, replies) of each row; one row's texts are in memory at a time."""
    for whole in given:
        for i in range(whole.num_rows):
            row = {c: whole.column(c)[i].as_py() for c in whole.schema.names}
            ids = np.array([np.iinfo(np.int64).max if d is None else d for d in row["doc_ids"]], np.int64)
            yield row["batch"], Batch(unpack(row["body"]), np.array(row["ends"], np.int64)), ids, row.get("replies") or [], row["doc_ids"]


def _rows(out: list[tuple], names: str, kinds: tuple) -> pa.RecordBatch:
    columns = zip(*out, strict=True) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names.split())


def _by_range(keys: np.ndarray, splitters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(range, indices in order) of the anchors."""
    ranges = np.searchsorted(splitters, keys >> np.uint64(1), side="right")
    order = np.argsort(ranges, kind="stable")
    cuts = np.flatnonzero(np.diff(ranges[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(ranges[part[0]]), part


def remove_repeats(docs: DataFrame, *, ranges: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) of every document. The table of batches stays, as the result reads it."""
    return repeats(docs, ranges=ranges)[0]


def repeats(docs: DataFrame, *, ranges: int | None = None) -> tuple[DataFrame, str]:
    """remove_repeats(), and the name of its table of batches, which may be dropped when the result has been written."""
    spark = docs.sparkSession
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"leafwise_{uuid.uuid4().hex}"
    batches_of(docs).write.option("compression", "uncompressed").bucketBy(buckets, "batch").saveAsTable(name, format="parquet")
    batches = spark.table(name)
    size = batches.agg(F.sum(F.element_at("ends", -1)).alias("n")).first()["n"] or 0
    ranges = ranges or max(buckets, int(size // RANGE_BYTES))
    marks = [i / ranges for i in range(1, ranges)]
    found = batches.select(F.explode("samples").alias("s")).agg(F.percentile_approx("s", marks, 10_000).alias("cuts")).first()["cuts"]
    splitters = np.array(sorted(found or []), np.uint64)
    kinds = (pa.int32(), pa.int64(), pa.binary())

    def ask(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts_, _, _, _ in _opened(given):
            _, _, h, keys, _ = texts_.anchors()
            yield _rows([(r, batch, h[part].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()) for r, part in _by_range(keys, splitters)], "range batch body", kinds)

    def answer(given: pa.Table) -> pa.Table:
        bodies = given.column("body").to_pylist()
        counts = [len(b) // 6 for b in bodies]
        six = np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, 6)
        h = np.zeros((len(six), 8), np.uint8)
        h[:, 2:] = six
        h = h.view("<u8").ravel()
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        again = np.zeros(len(h), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        bits = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(counts)[:-1])]
        return pa.table([given.column("range"), given.column("batch"), pa.array(bits, pa.binary())], names=["range", "batch", "body"])

    def send(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts_, ids, replies, _ in _opened(given):
            first, count, _, keys, lead = texts_.anchors()
            bits = {r["range"]: r["body"] for r in replies}
            out = []
            for r, part in _by_range(keys, splitters):
                flags = np.unpackbits(np.frombuffer(bits[r], np.uint8), count=len(part)).astype(bool)
                part = part[flags]
                if not len(part):
                    continue
                s, n, at = first[part], count[part], lead[part]
                place = np.searchsorted(texts_.ends, s, side="right")
                rows = texts_.context(s, n)
                kind = row_hash(rows, n)
                order = np.lexsort((ids[place], kind))
                new = np.concatenate([[True], kind[order][1:] != kind[order][:-1]])
                least = np.zeros(len(order), np.int64)
                least[order] = ids[place][order][np.flatnonzero(new)][np.cumsum(new) - 1]
                mine = ids[place] == least
                off = s - texts_.starts[place]
                if not mine.all():
                    out.append((r, -1 - batch, pack(place[~mine].astype("<i4"), off[~mine], (off + n + MATCH - 1)[~mine])))
                m, keep = int(mine.sum()), np.arange(80) < (n + MATCH - 1)[:, None]
                out.append((r, batch, pack(np.array([m], "<i8"), ids[place][mine], off[mine], place[mine].astype("<i4"), n[mine].astype(np.uint8), at[mine].astype(np.uint8), rows[mine][keep[mine]])))
            yield _rows(out, "range batch body", kinds)

    def judge(given: pa.Table) -> pa.Table:
        done, held = [], []
        for batch, body in zip(given.column("batch").to_pylist(), given.column("body").to_pylist(), strict=True):
            if batch < 0:  # covered within its batch already
                done.append((-1 - batch, body))
                continue
            raw = unpack(body)
            m = int(np.frombuffer(raw, "<i8", 1)[0])
            at, parts = 8, []
            for kind, width in (("<i8", 8), ("<i8", 8), ("<i4", 4), ("u1", 1), ("u1", 1)):
                parts.append(np.frombuffer(raw, kind, m, at))
                at += width * m
            held.append((batch, *parts, np.frombuffer(raw, np.uint8, offset=at)))
        if held:
            ids, off, place, n, lead = (np.concatenate([x[k] for x in held]) for k in range(1, 6))
            lengths = n.astype(np.int64)
            where = np.concatenate([[0], np.cumsum(lengths)])
            rows = np.zeros((len(n), WIDE), np.uint8)
            rows[np.arange(WIDE) < (lengths + MATCH - 1)[:, None]] = np.concatenate([x[6] for x in held])
            owner = np.repeat(np.arange(len(n)), lengths)
            covered = covered_windows(rows, lead.astype(np.int64), lengths, ids)[np.arange(SPAN) < lengths[:, None]]
            begins = covered & ~(np.concatenate([[False], covered[:-1]]) & np.concatenate([[False], owner[1:] == owner[:-1]]))
            stops = covered & ~(np.concatenate([covered[1:], [False]]) & np.concatenate([owner[1:] == owner[:-1], [False]]))
            i, j = np.flatnonzero(begins), np.flatnonzero(stops)
            o = owner[i]
            lo, hi = off[o] + (i - where[o]), off[o] + (j - where[o]) + MATCH
            sizes = np.cumsum([len(x[1]) for x in held])
            cuts = np.searchsorted(o, sizes)
            for k, (batch, *_) in enumerate(held):
                a, b = (cuts[k - 1] if k else 0), cuts[k]
                if b > a:
                    done.append((batch, pack(place[o[a:b]].astype("<i4"), lo[a:b], hi[a:b])))
        return pa.table([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.binary())], names=["batch", "body"])

    def cut(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts_, _, replies, doc_ids in _opened(given):
            edge = np.zeros(len(texts_.buf) + 1, np.int32)
            for r in replies:
                raw = unpack(r["body"])
                m = len(raw) // 20
                place, lo, hi = np.frombuffer(raw, "<i4", m), np.frombuffer(raw, "<i8", m, 4 * m), np.frombuffer(raw, "<i8", m, 12 * m)
                np.add.at(edge, texts_.starts[place] + lo, 1)
                np.add.at(edge, texts_.starts[place] + hi, -1)
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
            out = []
            for doc_id, a, b in zip(doc_ids, texts_.starts.tolist(), texts_.ends.tolist(), strict=True):
                g, raw = gone[a:b], texts_.buf[a:b]
                removed = int(g.sum())
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if removed else 0
                kept = raw[~g].tobytes() if removed else raw.tobytes()
                out.append((doc_id, b - a, removed, spans, sha256(kept).hexdigest(), kept))
            yield _rows(out, "doc_id n_bytes n_removed n_spans kept_sha256 kept", (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))

    def with_replies(replies: DataFrame) -> DataFrame:
        """The batches with all answers for them: at most one for each range and kind."""
        held = replies.groupBy("batch").agg(F.collect_list(F.struct(*[c for c in replies.columns if c != "batch"])).alias("replies"))
        return batches.select("batch", "doc_ids", "ends", "body").join(held.hint("shuffle_hash"), "batch", "left")

    schema = "range int, batch long, body binary"
    asked = batches.select("batch", "doc_ids", "ends", "body").mapInArrow(ask, schema)
    again = asked.groupBy("range").applyInArrow(answer, schema)
    sent = with_replies(again).mapInArrow(send, schema)
    covered = sent.groupBy("range").applyInArrow(judge, "batch long, body binary")
    return with_replies(covered).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"), name


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 50 bytes that earlier documents hold."""
    found, batches = repeats(table(spark, sf_dir, "documents"))
    out = kept_from(spark, lambda: found.drop("kept"))
    spark.sql(f"DROP TABLE {batches}")
    return out
