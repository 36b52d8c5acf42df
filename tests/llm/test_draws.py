"""Toxicity, the Merkle manifest and resampling, against brute force and planted cases."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwise.llm import merkle, resample, toxicity

DOCS = "doc_id long, source string, lang string, n_chars int, text string"
ODD = [(5, None, None, None, None), (None, "s", "xx", 3, "ABC"), (7, "s", None, 0, ""), (7, "s", None, 0, ""), (7, "t", None, 1, "É"), (8, "s", "yy", 2, "lone")]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_merkle(rows):
    """Level by level over whole groups, as the definition says."""
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    first = lambda v: (v is not None, v if v is not None else 0)
    low = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def rise(leaves):
        level, ways, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
        while len(level) > 1:
            for i, way in enumerate(ways):
                lo = at[i] // 8 * 8
                run = level[lo : lo + 8]
                way.append((run[: at[i] - lo], run[at[i] - lo + 1 :]))
                at[i] //= 8
            level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        return level[0], ways

    groups = {}
    for d, s, g, n, t in rows:
        groups.setdefault(g, []).append((first(d), h(*map(cell, (d, s, g, n, t))), h(*map(cell, (d, s, g, n, low(t)))), d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = {g: (sorted(groups[g]), *rise([x[1] for x in sorted(groups[g])])) for g in order}
    root, tops = rise([done[g][1] for g in order]) if order else ("", [])
    out = []
    for g, last in zip(order, tops, strict=True):
        held, sub, ways = done[g]
        for (_, leaf, changed, d), way in zip(held, ways, strict=True):
            way = way + last
            fold = changed if d is not None and crc32(str(d).encode()) % 3 == 0 else leaf
            for before, after in way:
                fold = h(*before, fold, *after)
            out.append((d, leaf, sub, root, h(*(x for b, a in way for x in b + a)), fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_merkle_equals_brute_force(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rnd = random.Random(levels)
    rows = ODD + [(i, rnd.choice("ab"), rnd.choice(["de", "en", "en", "en"]), i % 50, rnd.choice(["Words", "words", "", None])) for i in rnd.sample(range(10_000), 700)]
    rows += [(i, "s", f"g{i % 11}", 1, "x") for i in range(20)]  # more than eight groups
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("clash") for n in ("g", "o", "node", "at", "pos", "block", "top", "of", "proof", "total", "leaf")}).repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle(spark, f"file://{tmp_path}").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_merkle(rows)


def test_merkle_proofs_and_small_tables(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"text {i}") for i in range(9)], DOCS)
    rows = merkle.manifest(docs).orderBy("o").collect()
    assert [[(s.place, len(s.siblings)) for s in r.proof] for r in rows][:2] == [[(0, 7), (0, 1)], [(1, 7), (0, 1)]]
    assert [(s.place, len(s.siblings)) for s in rows[8].proof] == [(0, 0), (1, 1)] and rows[0].root == rows[0].subroot
    lone = merkle.manifest(docs.limit(1)).first()
    assert lone.proof == [] and lone.leaf == lone.root
    assert merkle.manifest(docs.filter("false")).count() == 0


def brute_features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(docs, target):
    bucket = lambda f: crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in part for f in brute_features(x)[1]) for part in ([d[1] for d in docs], target))
    every, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (every + 10000) / ((s[b] + 1) * (wanted + 10000))))
    out = []
    for i, (d, text) in enumerate(docs):
        w, f = brute_features(text)
        weight = sum(gain(bucket(x)) for x in f)
        u = int(sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), None, len(w), i])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def some_texts(rnd, n):
    words = ["Alpha", "beta", "Γάμμα", "delta9", "éa", "x" * 70, "naïve", "I", "日本語のとても長い単語である" * 3]
    return [(rnd.randrange(10**6), rnd.choice([" ", "\n", ", "]).join(rnd.choices(words, k=rnd.randint(0, 60)))) for _ in range(n)]


def test_resample_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resample, "RANGE_ROWS", 30)
    monkeypatch.setattr(resample, "RUN_ROWS", 20)
    monkeypatch.setattr(resample, "BLOCK_ROWS", 4)
    rnd = random.Random(1)
    docs = some_texts(rnd, 1200)
    docs += [docs[0]] * 3 + [(None, docs[1][1]), (None, None), (3, ""), (4, "one"), (5, "one two"), (6, "one two three")] + [(9, "same words " * 15)] * 40
    target = ["alpha beta", "Delta9 naïve alpha", "", None]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("row", "score", "rank", "part", "n", "a", "body")}).repartition(4)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == brute_resample(docs, target)
    assert resample.resample(df.filter("false"), df.select("text").limit(0)).count() == 0


def test_features_of_long_texts(monkeypatch):
    """A text in pieces has the features of the whole."""
    monkeypatch.setattr(resample, "CHUNK", 50)
    rnd = random.Random(2)
    values = [t for _, t in some_texts(rnd, 40)] + ["", "w" * 300, "a " * 99, " ", "A-b", "q" * 49 + " " + "r" * 60]
    got = [Counter() for _ in values]
    words = [0] * len(values)
    for first, text, bucket, sign, n in resample.by_text(values):
        for i, k in enumerate(n.tolist()):
            words[first + i] += k
        for i, b, s in zip(text.tolist(), bucket.tolist(), sign.tolist(), strict=True):
            got[first + i][b] += s
    for value, have, n in zip(values, got, words, strict=True):
        w, f = brute_features(value)
        assert n == len(w) and +have == Counter(crc32(x.encode()) % 10000 for x in f)


def test_tournament_merge():
    rnd = random.Random(3)
    entries = sorted((rnd.randrange(50), rnd.randrange(20), i) for i in range(900))
    runs = [sorted(rnd.sample(entries, 0)) for _ in range(13)]
    for e in entries:
        rnd.choice(runs).append(e)
    blocks = sorted((run[i : i + 7] for run in runs for i in range(0, len(run), 7)), key=lambda b: b[0])
    for take in (0, 1, 450, 900, 1000):
        assert list(resample.merge(iter([np.array(b).T for b in blocks]), take)) == [e[2] for e in entries[:take]]


def test_noisy_or_gradient():
    rnd = np.random.default_rng(4)
    label, n = np.array([1, 0, 1, 0]), np.array([3, 2, 1, 4])
    doc, sentence, trait = np.array([0, 0, 1, 3]), np.array([0, 0, 1, 2, 3, 3]), np.array([0, 1, 1, 2, 0, 2])
    w = rnd.normal(size=4)
    made = toxicity.noisy_or_sums(label, n, doc, sentence, trait, w)
    for i in range(4):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (toxicity.noisy_or_sums(label, n, doc, sentence, trait, up)[-1] - toxicity.noisy_or_sums(label, n, doc, sentence, trait, down)[-1]) / 2e-6
        assert abs(slope - made[i]) < 1e-4


def test_sentences_cover_every_word():
    text = "One two. THREE İstanbul four!\nfive " + "six seven " * 60 + "end"
    found = list(toxicity.sentences(text))
    assert [w for a, b, _ in found for w in toxicity.WORD.findall(text[a:b].lower())] == toxicity.WORD.findall(text.lower())
    assert all(len(toxicity.WORD.findall(text[a:b].lower())) <= toxicity.LONG for a, b, _ in found)


def test_toxicity_finds_documents_and_sentences(spark, tmp_path):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    plain = [word() for _ in range(150)]
    bad = ["vilename", "ogreish", "scoundrelly"]
    sentence = lambda: " ".join(rnd.choices(plain, k=8)).capitalize() + "."
    docs, labels, places = [], [], {}
    for i in range(700):
        own = [sentence() for _ in range(rnd.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            at = rnd.randrange(len(own))
            own[at] = f"{rnd.choice(plain)} {rnd.choice(bad)} {rnd.choice(plain)}."
            places[i] = (len(" ".join(own[:at])), own[at])
        docs.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    docs += [(None, None), (900, ""), (901, "vilename " * 30_000), (1, docs[1][1])]
    labels += [(2, 1), (None, 1), (902, None)]  # a contradiction, a null id, a null label
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("label", "score", "other", "n", "at", "trait", "offending")}).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(df, known).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    right = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 700]
    assert sum(right) / len(right) > 0.99 and by[901].score > 0.9 and by[900].score == by[None].score < 0.5
    texts = dict(docs)
    hits = [any(texts[i][s.start : s.end].strip() == own for s in by[i].offending) for i, (_, own) in places.items()]
    assert sum(hits) / len(hits) > 0.97
    assert sum(len(by[i].offending) for i in range(700) if i % 4) <= 3

    assert toxicity.toxicity(df.filter("false"), known).count() == 0
    assert {r.score for r in toxicity.toxicity(df.filter("doc_id < 9"), known.filter("toxic = 0")).collect()} == {0.0}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    rows = toxicity.op11_toxicity(spark, f"file://{tmp_path}").collect()
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
