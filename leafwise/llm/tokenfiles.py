"""Token ids in files of an adaptive context-mixing range coder (operator 2).

Ids are coded in blocks of BLOCK, each from a fresh model and with a checksum of
its ids, so a block can be read, or be found damaged, without the others. The
model is a mixture of id distributions: what followed the last two ids in the
block (order 2), what followed the last one (order 1), how often each id has
occurred in the block (order 0), and all ids alike. The weights are learned step
by step, for each state of trust in orders 2 and 1. A range coder of 64 bits
turns each id into its share of the mixture; an id that several orders name is
coded by the highest of them.

Blocks of a frame run side by side as lanes of numpy arrays, step by step, in
writing and reading alike. The frame's header has a checksum of its own.

Documents are range partitioned and sorted by doc_id; a partition is written as
frames of whole documents, one row of a Parquet file each. Positions within
partitions are known while writing; the partitions' totals, summed up in order,
give the starts in the whole.

Defined results: a null text counts as empty and has the end id alone; null
doc_ids come first; rows that share a doc_id follow each other; a text of any
length is one document in one frame, coded LANES blocks at a time; further
columns of the input are not read; an empty table gives an empty result. Ids
must be below 65535.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_letters
from .common import kept_from, remove, shared_dir, slices, table, texts

BLOCK = 1024
LANES = 8192  # blocks that are coded side by side
FRAME_IDS = LANES * BLOCK
BYTES = 16 << 20  # of texts that are encoded at once
MAGIC = b"LWT2"
SLOTS, SHIFT = 1 << 9, np.uint32(23)  # entries of a block's tables of orders 1 and 2, and what a 32-bit hash is shifted by to give one
SPREAD = np.array([[2654435761], [2246822519]], np.uint32)
ROWS = 128  # blocks whose order 0 is prepared at once for writing
#: Steps before which order 0 is counted anew.
COUNTED = (16, 48, 128, 256, 384, 512, 768)
U, TOP = np.uint64, (1 << 64) - 1
NONE, LOW16, LOW32 = 65535, np.uint32(65535), np.uint64((1 << 32) - 1)

#: Weights are kept as the ends of the shares of orders 2, 1 and 0 of 1 << 16, three fields of 20 bits in a number.
#: A step moves them by 1 / 32 towards the order that held, but leaves each share 64 or more.
#: States: the trusts (0 to 3) of order 2 and order 1, and whether both name the same id.
STATES, AGREE = 32, np.uint32(16)
TRUST, FULL, HIGH16 = np.array([[1 << 16], [4 << 16]], np.uint32), np.array([[(4 << 16) - 1], [(13 << 16) - 1]], np.uint32), np.uint32(65535 << 16)
RATE, FIELD, SLOW = 5, (1 << 20) - 1, 0x7FFF | 0x7FFF << 20 | 0x7FFF << 40
PLACES = np.array([[0], [20], [40]])
EVEN = 8192 | 12288 << 20 | 40960 << 40
TOWARDS = np.array([sum((65536 - (4 - i) * 96 if i > kind else i * 96) >> RATE << 20 * (i - 1) for i in (1, 2, 3)) for kind in range(4)], np.int64)


class Mixture:
    """The adaptive model of `lanes` blocks that are coded side by side.

    An id is drawn from a mixture of four distributions: what followed the last
    two ids (order 2), what followed the last id (order 1), how often ids have
    occurred in the block (order 0), and all ids alike. The weights are learned
    for each block and each state of trust in orders 2 and 1; where these two
    agree, they are one prediction with one weight.
    """

    def __init__(self, lanes: int) -> None:
        self.lane = np.arange(lanes, dtype=np.int64)
        self.after = np.full(2 * lanes * SLOTS, NONE, np.uint32)  # trust << 16 | the id that followed; orders 1 and 2
        self.base = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes) * SLOTS
        self.weights = np.full(lanes * STATES, EVEN, np.int64)
        self.states = self.lane * STATES
        self.last = np.zeros((2, lanes), np.uint32)
        self.n = 0  # ids of each block that order 0 has counted

    def count(self, ids: np.ndarray) -> None:
        """Order 0 from the ids so far (a row for each block): for each occurrence, sorted, id, place and number of its id's occurrences."""
        rows, self.n = ids.shape
        keys = (self.lane[:rows, None] << 16).astype(np.uint32) | ids
        keys.sort(axis=1)
        keys = keys.ravel()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(first, append=len(keys))
        self.keys = keys.take(first)
        self.runs = (size << 32) | (first % self.n << 16) | (self.keys & LOW16)
        self.size = size

    def held(self) -> np.ndarray:
        return self.runs.repeat(self.size)

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the first `n` blocks: the ids of orders 1 and 2, and where the weights of orders 2, 1 and 0 end."""
        hashes = self.last[:, :n] * SPREAD
        hashes[1] ^= hashes[0]
        self.slot = self.base[:, :n] + (hashes >> SHIFT)
        self.entry = self.after.take(self.slot)
        guess, trust = self.entry.astype(np.uint16), self.entry >> np.uint32(16)
        self.state = self.states[:n] + (trust[0] + trust[1] + (guess[0] == guess[1]) * AGREE)
        self.mix = self.weights.take(self.state)
        return guess, (self.mix >> PLACES & FIELD).view(U)

    def learn(self, n: int, ids: np.ndarray, kind: np.ndarray, held: np.ndarray) -> None:
        """`held`: where the ids of orders 1 and 2 were right."""
        self.weights[self.state] = self.mix - (self.mix >> RATE & SLOW) + TOWARDS.take(kind)
        self.last[1, :n] = self.last[0, :n]
        self.last[0, :n] = ids
        new = np.minimum(self.entry + TRUST, FULL)
        new &= held * HIGH16
        new |= self.last[0, :n]
        self.after[self.slot] = new


def chunks(longest: int) -> Iterator[tuple[int, int]]:
    """The stretches of steps between two counts of order 0."""
    at = [0, *(t for t in COUNTED if t < longest), longest]
    return zip(at[:-1], at[1:], strict=True)


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order 0 of each id (a row for each block, all ids known), a column for each block: size << 16 | place of its occurrences among the ids counted last, sorted. And 2 where it is among them, else 3."""
    lanes, longest = ids.shape
    out, kind = np.empty((longest, lanes), np.uint32), np.empty((longest, lanes), np.uint8)
    for row in range(0, lanes, ROWS):
        part = ids[row : row + ROWS]
        keys = part.astype(np.uint32) << np.uint32(16) | np.arange(longest, dtype=np.uint32)
        keys.sort(axis=1)
        first = np.ones(part.shape, bool)
        first[:, 1:] = (keys[:, 1:] ^ keys[:, :-1]) > LOW16
        # The number of each place's id among the distinct ids of all these blocks.
        number = np.empty(part.size, np.int64)
        number[((np.arange(len(part)) * longest)[:, None] + (keys & LOW16)).ravel()] = np.cumsum(first) - 1
        number = number.reshape(part.shape)
        block = np.flatnonzero(first) // longest
        size, upto = np.zeros(len(block), np.int64), 0
        for a, b in chunks(longest):
            size += np.bincount(number[:, upto:a].ravel(), minlength=len(block))
            runs = (size << 16 | np.cumsum(size) - size - a * block).astype(np.uint32).take(number[:, a:b]).T
            out[a:b, row : row + ROWS] = runs
            kind[a:b, row : row + ROWS] = 3 - (runs > LOW16).view(np.uint8)
            upto = a
    return out, kind


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block's ids as coded 32-bit words; blocks must not be empty.

    `low` and `width` are the interval of a range coder, 64 bits wide. A carry
    goes to the words before at once.
    """
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order])
    lanes, longest = len(blocks), int(sizes[0])
    ids = np.zeros((lanes, longest), np.uint16)
    for lane, i in enumerate(order):
        ids[lane, : len(blocks[i])] = blocks[i]
    model, (runs, other) = Mixture(lanes), counted(ids)
    low, width = np.zeros(lanes, U), np.full(lanes, TOP, U)
    out, at = np.zeros((longest + 2, lanes), np.uint32), np.zeros(lanes, np.int64)
    ends = np.zeros((5, lanes), U)
    n = lanes
    for a, b in chunks(longest):
        n = int(np.searchsorted(-sizes, -a, side="left"))
        coming = np.ascontiguousarray(ids[:n, a:b].T)
        for t in range(a, b):
            while sizes[n - 1] <= t:
                n -= 1
            x, w = coming[t - a, :n], width[:n]
            guess, shares = model.predict(n)
            one, two = held = guess == x
            kind = other[t, :n] * ~(one | two) + (one & ~two)
            r = w >> U(16)
            np.multiply(r, shares, out=ends[1:4, :n])
            ends[4, :n] = w
            spot = kind * np.int64(lanes) + model.lane[:n]
            add = ends.ravel().take(spot)
            w = ends.ravel().take(spot + lanes) - add
            k = np.flatnonzero(kind == 2)
            if len(k):
                e, r = runs[t].take(k), w.take(k) // U(a)
                add[k] += r * (e & LOW16)
                w[k] = r * (e >> np.uint32(16))
            k = np.flatnonzero(kind == 3)
            if len(k):
                r = w.take(k) >> U(16)
                add[k] += r * x.take(k)
                w[k] = r
            now = low[:n] + add
            k, back = np.flatnonzero(now < add), 1
            while len(k):
                spot = at.take(k) - back
                word = out[spot, k] + np.uint32(1)
                out[spot, k] = word
                k, back = k[word == 0], back + 1
            k = np.flatnonzero(w <= LOW32)
            if len(k):
                out[at.take(k), k] = now.take(k) >> U(32)
                at[k] += 1
                now[k] <<= U(32)
                w[k] <<= U(32)
            low[:n], width[:n] = now, w
            model.learn(n, x, kind, held)
    out[at, model.lane], out[at + 1, model.lane] = low >> U(32), low & LOW32
    words = np.ascontiguousarray(out[: int(at.max()) + 2].T).astype("<u4", copy=False)
    coded: list[bytes] = [b""] * lanes
    for lane, i in enumerate(order):
        coded[i] = words[lane, : at[lane] + 2].tobytes()
    return coded


def decode_blocks(coded: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """The ids of blocks from encode_blocks; `counts` says how many each holds."""
    order = sorted(range(len(coded)), key=lambda i: -counts[i])
    sizes = np.array([counts[i] for i in order])
    lanes, longest = len(coded), int(sizes[0])
    words = np.zeros((max(longest, max(len(c) for c in coded) // 4) + 4, lanes), np.uint32)
    for lane, i in enumerate(order):
        got = np.frombuffer(coded[i], "<u4", len(coded[i]) // 4)
        words[: len(got), lane] = got
    model = Mixture(lanes)
    width, code = np.full(lanes, TOP, U), words[0].astype(U) << U(32) | words[1]
    at = np.full(lanes, 2, np.int64)
    ids = np.zeros((lanes, longest), np.uint16)
    ends = np.zeros((5, lanes), U)
    n = lanes
    for a, b in chunks(longest):
        n = int(np.searchsorted(-sizes, -a, side="left"))
        rows = n
        held = np.zeros(n, np.int64)
        if a:
            model.count(ids[:n, :a])
            held = model.held()
        made = np.zeros((b - a, n), np.uint16)
        for t in range(a, b):
            while sizes[n - 1] <= t:
                n -= 1
            w, c = width[:n], code[:n]
            (g1, g2), shares = guess, _ = model.predict(n)
            r = w >> U(16)
            np.multiply(r, shares, out=ends[1:4, :n])
            ends[4, :n] = w
            beyond = (c >= ends[1:4, :n]).view(np.uint8)
            kind = beyond[0] + beyond[1] + beyond[2]
            spot = kind * np.int64(lanes) + model.lane[:n]
            low = ends.ravel().take(spot)
            w = ends.ravel().take(spot + lanes) - low
            c = c - low
            x = g1 + (g2 - g1) * (kind == 0)
            k = np.flatnonzero(kind == 2)
            if len(k):
                own, before = c.take(k), max(1, model.n)
                r = w.take(k) // U(before)
                e = held.take(k * before + np.minimum(own // np.maximum(r, U(1)), U(before - 1)).view(np.int64)).view(np.uint16).reshape(-1, 4)
                x[k] = e[:, 0]
                c[k] = own - r * e[:, 1]
                w[k] = r * e[:, 2]
            k = np.flatnonzero(kind == 3)
            if len(k):
                own, r = c.take(k), w.take(k) >> U(16)
                y = np.minimum(own // np.maximum(r, U(1)), U(LOW16))
                x[k] = y
                c[k] = own - r * y
                w[k] = r
            k = np.flatnonzero(w <= LOW32)
            if len(k):
                spot = at.take(k)
                c[k] = c.take(k) << U(32) | words[spot, k]
                at[k] = spot + 1
                w[k] <<= U(32)
            width[:n], code[:n] = w, c
            made[t - a, :n] = x
            model.learn(n, x, kind, guess == x)
        ids[:rows, a:b] = made.T
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * lanes
    for lane, i in enumerate(order):
        out[i] = ids[lane, : counts[i]]
    return out


def write_frame(start: int, doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """A frame: header, documents, block table, the checksum of all these, blocks. LANES blocks are coded at once."""
    if len(ids) and int(ids.max()) >= NONE:
        raise ValueError(f"ids must be below {NONE}")
    blocks = [ids[a : a + BLOCK] for a in range(0, len(ids), BLOCK)]
    coded = [c for a in range(0, len(blocks), LANES) for c in encode_blocks(blocks[a : a + LANES])]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    heads = np.array([(len(b), crc32(b.astype("<u4").tobytes()), len(c)) for b, c in zip(blocks, coded, strict=True)], "<u4")
    head = b"".join([MAGIC, struct.pack("<qII", start, len(doc_ids), len(blocks)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array(sizes, "<u4").tobytes(), heads.tobytes()])
    return b"".join([head, struct.pack("<I", crc32(head)), *coded])


def read_frame(body: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(start, doc_ids, sizes, ids) of a frame; raises ValueError if the checksum of the header or of a block fails."""
    if body[:4] != MAGIC or len(body) < 24:
        raise ValueError("not a token frame")
    start, docs, blocks = struct.unpack_from("<qII", body, 4)
    upto = 20 + 13 * docs + 12 * blocks
    if len(body) < upto + 4 or struct.unpack_from("<I", body, upto)[0] != crc32(body[:upto]):
        raise ValueError("the header is damaged")
    at = 20
    doc_ids, at = np.frombuffer(body, "<i8", docs, at), at + 8 * docs
    known, at = np.frombuffer(body, "u1", docs, at), at + docs
    sizes, at = np.frombuffer(body, "<u4", docs, at), at + 4 * docs
    heads = np.frombuffer(body, "<u4", 3 * blocks, at).reshape(-1, 3)
    ends = upto + 4 + np.cumsum(heads[:, 2].astype(np.int64))
    coded = [body[e - int(n) : e] for e, n in zip(ends.tolist(), heads[:, 2], strict=True)]
    if any(len(c) < 8 or len(c) != n for c, n in zip(coded, heads[:, 2].tolist(), strict=True)):
        raise ValueError("the frame is cut short")
    found = [x for a in range(0, blocks, LANES) for x in decode_blocks(coded[a : a + LANES], heads[a : a + LANES, 0].tolist())]
    for nr, (block, head) in enumerate(zip(found, heads, strict=True)):
        if crc32(block.astype("<u4").tobytes()) != head[1]:
            raise ValueError(f"block {nr} is damaged")
    return start, [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], sizes, np.concatenate([np.zeros(0, np.uint16), *found]).astype("<u4")


def laid(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of `pool`, one behind the other."""
    total = int(size.sum())
    shift = (start - (np.cumsum(size) - size)).astype(np.int32 if max(total, len(pool)) < 1 << 30 else np.int64)
    return pool.take(np.repeat(shift, size) + np.arange(total, dtype=shift.dtype))


class ByteCoder:
    """Whole texts to ids with a byte-level tokenizer file.

    Texts of a batch are cut at single spaces into runs; each distinct run is cut
    into pieces (between the file's own cuts) once in the batch. The distinct pieces
    are handed to the library's model, many at once, with a letter between them
    that no merge reaches over; that takes less time than to look them up in a
    store of earlier batches' pieces.
    """

    #: Texts with these are left to the library: special tokens, control and far letters.
    ELSE = re.compile("<\\||[\x1c-\x1fƀ-\U0010ffff]")
    #: Runs with these, and empty ones, stand beside other white space: their text's pieces are found in the whole text.
    ODD = "^$|[\t\x0b-\r\x85\xa0]|^\n|\n$|" + ELSE.pattern
    #: The word pattern of byte-level files, for letters up to U+017F.
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ſ]+| ?[0-9²³¹¼½¾]+| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ſ0-9²³¹¼½¾]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")
    #: A byte of no UTF-8 text.
    BETWEEN = 255
    #: Pieces in one call of the model, texts whose ids are put together at once, and pieces of odd texts that are looked at together.
    AT_ONCE, TEXTS, MANY = 100, 200, 300_000

    def __init__(self, path: str) -> None:
        self.rules = Tokenizer.from_file(path)
        self.rules.no_truncation()
        self.rules.no_padding()
        model, letters = self.rules.model, byte_letters()
        self.model = Tokenizer(model)  # without the file's own cuts
        self.letters = np.array([ord(x) for x in letters], np.uint16)
        alone = sum(letters[self.BETWEEN] in entry for entry in self.rules.get_vocab(with_added_tokens=False)) == 1
        split = alone and not (model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix)
        self.between, self.at_once = self.model.token_to_id(letters[self.BETWEEN]), self.AT_ONCE if split else 1

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one behind the other, and where each piece's begin (then the end)."""
        number = {piece: k for k, piece in enumerate(dict.fromkeys(pieces))}
        names, mark, coded = list(number), bytes([self.BETWEEN]) * (self.at_once > 1), [np.zeros(0, "<u4")]
        for k in range(0, len(names), self.at_once):
            joined = mark.join([name.encode() for name in names[k : k + self.at_once]]) + mark
            spelt = self.letters[np.frombuffer(joined, np.uint8)].astype("<u2").tobytes().decode("utf-16-le")
            coded.append(np.array(self.model.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, "<u4"))
        pool = np.concatenate(coded)
        ends = np.flatnonzero(pool == self.between) if mark else np.cumsum([len(ids) for ids in coded[1:]], dtype=np.int64)
        start = np.append(0, ends[:-1] + len(mark))[: len(ends)]
        order = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
        size = (ends - start)[order]
        return laid(pool, start[order], size), np.append(0, np.cumsum(size))

    def code_odd(self, texts: pa.StringArray, odd: list[int]) -> Iterator[tuple[int, bytes]]:
        """The numbers of odd texts and their ids."""
        some: list[tuple[int, int]] = []
        pieces: list[str] = []
        for k in odd:
            text = texts[k].as_py()
            if self.ELSE.search(text) is not None:
                yield k, array("I", self.rules.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                pieces += self.PIECES.findall(text)
                some.append((k, len(pieces)))
            if some and (len(pieces) >= self.MANY or k == odd[-1]):
                ids, place = self.encode(pieces)
                last = 0
                for nr, upto in some:
                    yield nr, ids[place[last] : place[upto]].tobytes()
                    last = upto
                some, pieces = [], []

    def code_all(self, texts: pa.StringArray) -> Iterator[bytes]:
        """The ids of each text."""
        cut = pc.split_pattern(texts, " ")
        runs = cut.flatten().dictionary_encode()
        which = runs.indices.to_numpy(zero_copy_only=False).copy()
        begin = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        odd = pc.match_substring_regex(runs.dictionary, self.ODD)
        names, odd = runs.dictionary.filter(pc.invert(odd)), odd.to_numpy(zero_copy_only=False)
        alone = np.logical_or.reduceat(odd[which], begin)
        # Runs hold no spaces, so they can leave Arrow as one string, and a piece with a space begins a run.
        found = self.PIECES.findall(" " + pc.binary_join(pa.ListArray.from_arrays([0, len(names)], names), " ")[0].as_py()) if len(names) else []
        heads = np.flatnonzero([piece[0] == " " for piece in found])
        # The first run of a text has no space before it.
        firsts = [[] if skip else self.PIECES.findall(run) for run, skip in zip(runs.dictionary.take(pa.array(which[begin])).to_pylist(), alone.tolist(), strict=True)]
        count = np.zeros(len(odd) + len(firsts), np.int64)
        count[: len(odd)][~odd] = np.diff(heads, append=len(found))
        count[len(odd) :] = [len(own) for own in firsts]
        which[begin] = np.arange(len(firsts)) + len(odd)
        for own in firsts:
            found += own
        # From pieces to runs, and from runs to texts.
        (pool, upto), last = self.encode(found), np.cumsum(count)
        start, size = upto[last - count], upto[last] - upto[last - count]
        apart = dict(self.code_odd(texts, np.flatnonzero(alone).tolist()))
        begin = np.append(begin, len(which))
        for first in range(0, len(firsts), self.TEXTS):
            cuts = begin[first : first + self.TEXTS + 1]
            some = which[cuts[0] : cuts[-1]]
            ids, place = laid(pool, start[some], size[some]), np.append(0, np.cumsum(size[some]))[cuts - cuts[0]].tolist()
            for k, (a, b) in enumerate(zip(place[:-1], place[1:], strict=True), first):
                yield apart[k] if alone[k] else ids[a:b].tobytes()


@lru_cache(1)
def coder_of(path: str) -> ByteCoder:
    return ByteCoder(path)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 2) -> None:
    """Write `docs` in doc_id order as frames to `path`: Parquet files with part, frame, n_ids, body."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = coder_of(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        start = frame = held_ids = 0
        names: list = []
        parts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            sizes = [len(p) // 4 for p in parts]
            body = write_frame(start, names, sizes, np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([sum(sizes)], pa.int64()), pa.array([body], pa.binary())], names=["part", "frame", "n_ids", "body"])

        for batch in (part for whole in given for part in slices(whole, "text", BYTES)):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.code_all(batch.column("text")), strict=True):
                ids += end
                if parts and held_ids + len(ids) // 4 > FRAME_IDS:
                    yield flush()
                    start, frame, held_ids, names, parts = start + held_ids, frame + 1, 0, [], []
                names.append(doc_id)
                parts.append(ids)
                held_ids += len(ids) // 4
        if parts:
            yield flush()

    # Rows that share a doc_id, or have none, are told apart by a hash, so that any number of them is dealt over partitions.
    ordered = texts(docs).withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    ordered.select("doc_id", "text").mapInArrow(run, "part int, frame int, n_ids long, body binary").write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if `with_ids`, ids (binary) of the documents in the files at `path`."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for part, body in zip(batch.column("part").to_pylist(), batch.column("body"), strict=True):
                start, doc_ids, sizes, ids = read_frame(body.as_py())
                ends = np.cumsum(sizes.astype(np.int64))
                own = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64()), pa.array([part] * len(own), pa.int32()), pa.array(start + ends - sizes), pa.array(sizes.astype(np.int64)), pa.array([crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(own, pa.binary())] if with_ids else []), names=["doc_id", "part", "place", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    files = spark.read.parquet(path)
    found = files.select("part", "body").mapInArrow(run, "doc_id long, part int, place long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    # One row for each written partition: their running total is small whatever the corpus.
    before = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return found.join(before, "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files, read back from them."""
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    out = kept_from(spark, lambda: read_tokens(spark, path))
    remove(spark, path)
    return out
