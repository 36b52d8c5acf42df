"""Operators over many rows against brute force: substrings, embeddings, URLs, quotes, benchmark copies, pipeline."""

import random
from hashlib import sha256

import duckdb
import numpy as np
from pyspark.sql import functions as F

from leafwise.llm import decontaminate, embeddings, graph, quotes, substrings, urls


def brute_removal(rows, m=50):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        t = (t or "").encode()
        for i in range(len(t) - m + 1):
            first.setdefault(t[i : i + m], d)
    out = []
    for d, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - m + 1):
            if first[t[i : i + m]] < d:
                gone[i : i + m] = b"\1" * m
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def test_substrings(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_BYTES", 3000)
    rnd = random.Random(3)
    parts = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(30, 200))) for _ in range(12)] + ["x" * 120, "abcd" * 40, "é" * 60]
    rows = [(i, "".join(rnd.choice([*parts, str(rnd.random())]) for _ in range(rnd.randint(0, 6)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "x" * 49), (203, "x" * 50), (204, "x" * 1000), (204, "y" * 60), (204, "y" * 60)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "batch": F.lit(1)}).repartition(3)
    got = sorted(tuple(r) for r in substrings.remove_repeats(docs, ranges=3).drop("kept").collect())
    assert got == brute_removal(rows)


def test_suffix_order():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(97, 99, (300, 19)), np.repeat(rng.integers(97, 99, (5, 19)), 9, axis=0)]).astype(np.uint8)
    order, lcp = substrings.suffix_order(rows)
    texts = [bytes(r) for r in rows]
    assert [texts[i] for i in order] == sorted(texts)
    for k in range(1, len(order)):
        a, b = texts[order[k - 1]], texts[order[k]]
        assert lcp[k] == next((i for i in range(19) if a[i] != b[i]), 19)


def test_substrings_null_ids(spark):
    rows = [(None, "z" * 70), (None, "z" * 70 + "end"), (5, "z" * 60), (2**62, "q" * 55 + "z" * 55)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 60): 0, (2**62, 110): 55, (None, 70): 70, (None, 73): 70}


def test_substrings_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), ranges=2).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 16))
    rows, v = [], 0
    for _ in range(260):
        x = centres[rng.integers(8)] + rng.standard_normal(16) * rng.choice([0.02, 0.3, 1.5])
        for _ in range(rng.choice([1, 1, 1, 3])):
            rows.append((v, [float(np.float32(a)) for a in x], int(rng.integers(3))))
            v += 1
    rows += [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, rows[0][1], None), (9004, [1.0, 2.0], 1), (9005, [2.0, 4.0], 1), (9006, [1.0, None], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    up = {r[0]: r[0] for r in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = dict.fromkeys(up, 0)
    fine = [(i, np.array(e, float), y) for i, e, y in rows if e is not None and y is not None and None not in e and np.isfinite(e).all() and any(e)]
    for k, (i, a, y) in enumerate(fine):
        for j, b, z in fine[:k]:
            if y == z and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {i: (links[i], root(i), root(i) == i) for i in up}
    assert embeddings.near_duplicates(df.filter("false")).count() == 0


def test_embeddings_in_tiles(spark, monkeypatch):
    """Tiles of few points, so that components have tiles that link wholly, in part and not at all; repeats that disagree, clashing columns."""
    monkeypatch.setattr(embeddings, "TILE", 5)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((3, 12))
    rows = [(i, [float(np.float32(a)) for a in base[i % 3] + rng.standard_normal(12) * (0.01, 0.2, 0.35)[i % 3]], 1) for i in range(90)]
    rows += [(200, [float(x) for x in base[0]], 1), (200, [float(x) for x in -base[0]], 1), (None, [float(x) for x in base[0]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"n": F.lit("clash"), "point": F.lit("clash"), "v": F.lit("clash"), "component": F.lit(0)})
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    fine = [(i, np.array(np.float32(e), float)) for i, e, _ in rows if i is not None]
    unit = np.array([v / np.linalg.norm(v) for _, v in fine])
    near = unit @ unit.T >= 0.93
    for k in range(90):
        others = {fine[j][0] for j in np.flatnonzero(near[k])} - {k}
        assert got[k] == len(others)
    assert got[None] == 0


def test_planted_links_of_scattered_vectors(spark):
    """Pairs at cosine 0.935 among vectors without any other neighbours, with ids that no round number divides."""
    rng = np.random.default_rng(2)
    n, planted = 8000, 600
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.standard_normal((planted, 64))
    r -= (r * x[:planted]).sum(axis=1, keepdims=True) * x[:planted]
    y = 0.935 * x[:planted] + np.sqrt(1 - 0.935**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    rows = [(50 * i + 7, v.tolist(), 1) for i, v in enumerate(np.vstack([x, y]))]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert found.agg(F.sum("n_links")).first()[0] >= 0.99 * 2 * planted


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rnd.randint(100, 200), rnd.randint(100, 200)) for _ in range(60)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {x: x for p in pairs for x in p}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    alone = {a for a, b in pairs if a == b}
    assert {n: c for n, c in got.items()} == {n: root(n) for n in up if n in got} and set(up) - set(got) <= alone


def test_urls(spark):
    rows = [
        "http://www.example.com/en/x", "https://EXAMPLE.com/en/", "http://a.example.com/en/?q", "http://a.www.example.com/en/1", "http://example.com/fr/", "http://example.com", "http://x.net/es/1#y", "http://net/fr/",
        "http://notexample.com/en/1", "http://example.com:80/en/", "no scheme", "", None, "x://y://example.com/en/", "http://example.com?/en/", "ftp://b.org/z", "http://x.net/en/", "http://.com/", "http://a..com/\n",
    ] * 2
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, urls.RULES)) + " AS r(verdict, host, path)")
    got = sorted((tuple(r) for r in urls.filter_urls(pages, rules).collect()), key=lambda r: r[0])

    def judge(i, url):
        if url is None or "://" not in url:
            return (i, "", "", None, "allow")
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h), len(p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, 0, None, "allow")
        return (i, host, path, best[2], best[3])

    assert got == [judge(i, u) for i, u in enumerate(rows)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(rows)))
    assert sorted(con.execute(urls.ORACLE).fetchall(), key=lambda r: r[0]) == got
    assert urls.filter_urls(pages.filter("false"), rules).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "First point here.\nSecond, point!"),
        (1, 1, "assistant", "An answer\nof two lines"),
        (1, 2, "user", "On Monday, Ann wrote:\n> first point   HERE\n> Second point\nI agree."),
        (1, 3, "user", "> > First point here.\n> I agree.\nMe too."),
        (1, 4, "user", "> unknown line\n"),
        (2, 0, "user", None),
        (2, 1, "user", "> First point here.\nother conversation"),
        (None, 5, "user", "> x"),
        (2, 1, "user", "> First point here.\nother conversation"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("lines", F.lit(0))
    out = sorted(((r.conv_id, r.turn, r.body, r.quote_depth, r.reply_to, r.n_quoted, r.thread_root, r.thread_depth) for r in quotes.reply_order(df).collect()), key=str)
    want = [
        (1, 0, "First point here.\nSecond, point!", 0, None, 0, 0, 0),
        (1, 1, "An answer\nof two lines", 0, None, 0, 1, 0),
        (1, 2, "I agree.", 1, 0, 2, 0, 1),
        (1, 3, "Me too.", 2, 2, 1, 0, 2),
        (1, 4, "", 1, None, 0, 4, 0),
        (2, 0, "", 0, None, 0, 0, 0),
        (2, 1, "other conversation", 1, None, 0, 1, 0),
        (None, 5, "", 1, None, 0, 5, 0),
        (2, 1, "other conversation", 1, None, 0, 1, 0),
    ]
    assert out == sorted(want, key=str)
    assert quotes.reply_order(df.filter("false")).count() == 0
    lists = {(r.conv_id, r.thread_root, r.part): [(m.role, m.body) for m in r.turns] for r in quotes.chats(quotes.reply_order(df), part=2).collect()}
    assert lists == {
        (1, 0, 0): [("user", "First point here.\nSecond, point!"), ("user", "I agree.")], (1, 0, 1): [("user", "Me too.")],
        (1, 1, 0): [("assistant", "An answer\nof two lines")], (2, 1, 0): [("user", "other conversation")] * 2,
    }


def test_decontamination(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(15, 40)))) for i in range(12)] + [(50, ""), (51, None), (52, "two words")]
    noise = lambda n: " ".join(word() for _ in range(n))
    docs, want = [], set()
    for i, t in items[:12]:
        w = t.split()
        edited = " ".join(noise(1) if k % 9 == 4 else x for k, x in enumerate(w))
        for k, body in enumerate((t.upper() + ".", edited)):
            docs.append((i * 10 + k, f"{noise(60)} {body}\n{noise(50)}"))
            want.add((i * 10 + k, i))
        docs.append((i * 10 + 5, f"{noise(30)} {' '.join(w[:6])} {noise(30)}"))
    docs += [(900 + i, noise(200)) for i in range(20)] + [(990, None), (991, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert got == want
    assert decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark.filter("false")).count() == 0


def test_alignment_scores():
    def slow(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    rnd = random.Random(3)
    for _ in range(60):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(1, 14))] for _ in range(2))
        assert decontaminate.align(a, b)[0] == slow(a, b)


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "encode"]
    held = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        assert 0 < len(rows) <= held.count() and len({r.doc_id for r in rows}) == len(rows)
        held = spark.createDataFrame(rows, docs.schema)
    done = corpus_pipeline.STAGES[-1][1](spark, held, sf_dir)
    assert done.count() == held.count() and "ids_sha256" in done.columns
