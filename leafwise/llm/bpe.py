"""BPE encoding and decoding by a dynamic program over prefixes (operator 1).

For every prefix of a pre-token exactly one vocabulary entry can be the last
token of the prefix's encoding. An automaton over the vocabulary with suffix links
reads the word once, from left to right: its state is the longest part of an entry
that ends here, and the links lead to all entries that end here, the longest
first. The entry is taken whose start prefix ends in a token that is compatible
with it. Two tokens are compatible if the merges, replayed on both together,
leave them apart. Following the stored last tokens backwards from the end of the
word gives the exact ids.

Texts are lines of work of their own: no shuffle, no state between rows but
bounded stores of encoded words.

Defined results: a null text counts as empty; an empty text has no tokens, the
hash of no bytes and an empty decoded text; a text of any length is encoded
whole; repeated rows give repeated rows; an empty table gives an empty result;
further columns of the input are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import held, map_texts, table, texts

#: Stands for the end-of-word mark inside words; no byte maps to it.
END = "\ue000"
#: Words, runs of words and token pairs that a Python worker keeps, half of them as an older generation.
WORDS, RUNS, PAIRS = 240_000, 80_000, 120_000


def byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 bytes stand for themselves, the others count up from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Kept(dict):
    """Key -> what `make` gives for it. Of two generations the older one is forgotten when the younger is full, so what is often asked stays."""

    def __init__(self, make: Callable, most: int) -> None:
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


class PrefixEncoder:
    """Encodes single pre-tokens with the vocabulary and merges of a tokenizer file."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.most = most = max(vocab.values()) + 1
        self.rank: dict[int, int] = {}  # of a pair: left * most + right
        self.made = array("i", [-1]) * most  # the rank of the merge that makes a token
        self.left, self.right = array("i", [0]) * most, array("i", [0]) * most
        for rank, (a, b) in enumerate(merges):
            token = vocab[a + b]
            self.rank[vocab[a] * most + vocab[b]] = rank
            self.made[token], self.left[token], self.right[token] = rank, vocab[a], vocab[b]
        self.apart = Kept(lambda pair: self.compatible(*divmod(pair, most)), PAIRS // 2)
        self.letters = dict(enumerate(byte_letters()))
        letters = set(self.letters.values())
        entries: list[tuple[str, int]] = []
        for text, token in vocab.items():
            body = text.removesuffix(self.mark) if self.mark and text.endswith(self.mark) else text
            if not body or not set(body) <= letters:
                continue
            if self.made[token] >= 0 and not self.compatible(self.left[token], self.right[token], upto=self.made[token]):
                continue  # the merges never reach this entry
            entries.append((body + END if body != text else body, token))
        self.build(entries)

    def build(self, entries: list[tuple[str, int]]) -> None:
        """The automaton: steps of each state; the state of its longest proper suffix; token and length where an entry ends; the next such state by suffixes."""
        steps: list[dict[str, int]] = [{}]
        token, length = array("i", [-1]), array("i", [0])
        for text, number in entries:
            at = 0
            for letter in text:
                further = steps[at].get(letter)
                if further is None:
                    further = steps[at][letter] = len(steps)
                    steps.append({})
                    token.append(-1)
                    length.append(length[at] + 1)
                at = further
            token[at] = number
        suffix, entry = array("i", bytes(4 * len(steps))), array("i", bytes(4 * len(steps)))
        level = [0]
        while level:
            below = []
            for at in level:
                for letter, further in steps[at].items():
                    back = suffix[at]
                    while at and back and letter not in steps[back]:
                        back = suffix[back]
                    suffix[further] = steps[back].get(letter, 0) if at else 0
                    entry[further] = further if token[further] >= 0 else entry[suffix[further]]
                    below.append(further)
            level = below
        none: dict[str, int] = {}
        steps = [s or none for s in steps]  # most states lead nowhere
        self.steps, self.suffix, self.entry, self.token, self.length = steps, suffix, entry, token, length

    def compatible(self, left: int, right: int, upto: float = float("inf")) -> bool:
        """Whether no merge below rank `upto` joins the two tokens, or parts of them, over their border.

        The later made of the two that touch the border is taken apart, so the
        pairs met are those that really stood side by side while merging. At
        equal ranks the pair further left merges first.
        """
        made, rank, most = self.made, self.rank, self.most
        while True:
            joined = rank.get(left * most + right)
            if joined is not None and joined < upto:
                return False
            a, b = made[left], made[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                left, upto = self.right[left], a
            else:
                right, upto = self.left[right], b + 1

    def encode(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        return self.encode_letters(word.encode().decode("latin-1").translate(self.letters))

    def encode_letters(self, text: str) -> list[int]:
        """The ids of one pre-token whose bytes are written in byte letters."""
        if self.mark:
            text += END
        size = len(text)
        last = [-1] * (size + 1)  # the token that ends each prefix
        lengths = [0] * (size + 1)
        steps, suffix, entry, tokens, sizes, apart, most = self.steps, self.suffix, self.entry, self.token, self.length, self.apart, self.most
        at = 0
        for end, letter in enumerate(text, 1):
            while (further := steps[at].get(letter)) is None and at:
                at = suffix[at]
            at = further or 0
            fits = entry[at]
            while fits:
                token, n = tokens[fits], sizes[fits]
                if n == end or (before := last[end - n]) >= 0 and apart[before * most + token]:
                    last[end], lengths[end] = token, n
                    break
                fits = entry[suffix[fits]]
        ids = []
        while size:
            ids.append(last[size])
            size -= lengths[size]
        return ids[::-1]


class TextCoder:
    """Whole texts to ids and back, for files of the word-end kind (lower case, white space dropped)."""

    #: Texts without these letters are cut into words here; for others the tokenizer file's own normaliser and word rules are run.
    ELSE = re.compile("[\\x1c-\\x1f\\u0130\\u0180-\\U0010ffff]")
    #: The file's word pattern, for lower-case letters up to U+017F.
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ſ0-9²³¹¼½¾]+")

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rules = Tokenizer.from_file(path)  # its model is not needed
        self.normalize, self.pre_tokenize = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.encoder = PrefixEncoder(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in self.special) + ")")
        words = Kept(lambda w: array("I", self.encoder.encode(w)).tobytes(), WORDS // 2)
        self.plain = Kept(lambda run: b"".join([words[w] for w in self.WORDS.findall(run)]), RUNS // 2)
        self.lettered = Kept(lambda w: array("I", self.encoder.encode_letters(w)).tobytes(), RUNS // 4)
        #: The text of each id; ids that no entry has stand for no text.
        entries = [*spec["model"]["vocab"].items(), *self.special.items()]
        self.texts = [""] * (max(i for _, i in entries) + 1)
        for text, i in entries:
            self.texts[i] = text

    def part(self, text: str) -> list[bytes]:
        if self.ELSE.search(text) is None:
            return list(map(self.plain.__getitem__, text.lower().split()))
        words = self.pre_tokenize(self.normalize(text))
        return [self.lettered[w] for w, _ in words]

    def code(self, text: str) -> bytes:
        """A text's ids as little-endian bytes."""
        if "<|" not in text:
            return b"".join(self.part(text))
        out: list[bytes] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out += self.part(part)
        return b"".join(out)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.code(text), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.texts.__getitem__, ids.tolist()))


def coder_of(path: str) -> TextCoder:
    """One coder for all tasks of a Python worker, until it does other work."""
    return held(TextCoder, path)


def bpe_encode(docs: DataFrame, tokenizer: str, *, with_ids: bool = False) -> DataFrame:
    """Ids and decoded text of every whole text.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if `with_ids`, the
    ids (binary, little-endian unsigned 32-bit). `tokenizer` is the path of the
    tokenizer file on every executor.
    """

    def start() -> Callable[[str], tuple]:
        coder = coder_of(tokenizer)

        def judge(text: str) -> tuple:
            ids = coder.code(text)
            back = coder.decode(np.frombuffer(ids, "<u4")).encode()
            row = len(ids) // 4, sha256(ids).hexdigest(), sha256(back).hexdigest()
            return (*row, ids) if with_ids else row

        return judge

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return map_texts(texts(docs), start, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, encoded and decoded with the word-end vocabulary."""
    import public_tokenizers

    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
