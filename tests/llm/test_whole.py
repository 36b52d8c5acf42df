"""Cases in which an operator once did less than the whole job, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from leafwise.llm import decontaminate, quotes, shingles


def least_of(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_near_copies_equal_brute_force(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(shingles, "TILE", 8)
    monkeypatch.setattr(shingles, "GROUP", 5)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    frame = [word() for _ in range(60)]  # shared by many texts that are no copies of each other
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(60, 160))]
        for _ in range(5):
            w = list(base)
            for k in rnd.sample(range(len(w)), rnd.randint(0, 5)):
                w[k] = word()
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join([*frame, *(word() for _ in range(rnd.randint(8, 40)))])) for i in range(60)]
    rows += [(1000, "two words"), (1001, "Two  WORDS"), (1002, "two"), (1003, ""), (1004, None), (None, rows[0][1]), (1005, "a b c d e"), (1006, "a b c d f")]
    rnd.shuffle(rows)

    def brute_set(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: brute_set(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert any(10 * len(sets[a] & sets[b]) < 9 * len(sets[a] | sets[b]) for a, b in links)
    want = least_of(ids, links)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in shingles.near_copies(docs).collect()}
    copied = next(i for i, t in rows if i is not None and t == dict(rows)[None])
    assert got.pop(None) == want[copied] and got == want
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == [i for i in ids if want[i] == i]
    assert shingles.near_copies(docs.filter("false")).count() == 0


def test_repeated_and_evenly_edited_leaks_are_found(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(6))
    noise = lambda n: " ".join(word() for _ in range(n))
    item = [word() for _ in range(38)]
    edited = " ".join(word() if k in (6, 12, 18, 24, 30, 33, 36) else x for k, x in enumerate(item))
    fourth = " ".join(word() if k % 4 == 3 else x for k, x in enumerate(item))
    docs = [(1, f"{noise(9)} {' '.join(item)} {noise(9)}"), (2, f"{noise(40)} {fourth} {noise(40)}"), (3, f"{noise(20)} {' '.join(item[:8])} {noise(20)}")]
    docs += [(100 + i, f"{noise(40)} {edited} {noise(40)}") for i in range(200)]
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert got == {(1, 7), (2, 7)} | {(100 + i, 7) for i in range(200)}


def test_nested_and_rewrapped_quotes(spark):
    rows = [
        (1, 0, "first line here\nsecond line here\nthird line here"),
        (1, 1, "> first line here\n> second line here\n> third line here\nmy answer to all this"),
        (1, 2, "> > first line here\n> > second line here\n> > third line here\n> my answer to all this\nfine"),
        (1, 3, "a sentence of some length that the\nmail program wraps in another place\nwhen it is quoted"),
        (1, 4, "> a sentence of some length\n> that the mail program wraps in\n> another place when it is quoted\nyes"),
        (1, 5, "> > first line here\nonly deeper"),
        (2, 0, "so\nbe it"),
        (2, 1, "> so be it\nfine"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread_depth) for r in quotes.reply_order(df).collect()}
    assert got == {(1, 0): (None, 0), (1, 1): (0, 1), (1, 2): (1, 2), (1, 3): (None, 0), (1, 4): (3, 1), (1, 5): (0, 1), (2, 0): (None, 0), (2, 1): (0, 1)}


STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string, spans string, t long, _text string"


def stage_rows(rows):
    return [(i, t, "en", "web", len(t or ""), "clash", "clash", 7, "clash") for i, t in rows]


def test_stages_tell_rows_apart(spark, monkeypatch, tmp_path):
    """Null and repeated doc_ids, repeated rows, empty texts, clashing columns, empty tables in every stage."""
    import corpus_pipeline

    rnd = random.Random(7)
    noise = lambda n: " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(6)) for _ in range(n))
    item, one, two, three = noise(30), noise(60), noise(70), noise(50)
    secret = "pass: " + "x9" * 165 + "\nuser: bob\nhost: db.example.com"
    leak = f"{noise(20)} {item} {noise(20)}"
    rows = [(None, leak), (1, f"{leak} end"), (1, two), (2, one), (2, three), (2, three), (None, one), (None, two + " x"), (3, secret), (None, f"{secret} more"), (4, ""), (5, None), (None, "")]
    sf_dir = str(tmp_path)
    spark.createDataFrame([(7, item), (8, None), (None, item)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.createDataFrame(stage_rows(rows), STAGE_SCHEMA).repartition(3)
    named = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert named(corpus_pipeline.quality(spark, docs, sf_dir)) == sorted(rows, key=str)
    # copies: `leak` and its longer form, `three` twice, `one` without an id, `two` and its longer form without an id, the secrets, the empty texts
    want = [(1, f"{leak} end"), (1, two), (2, one), (2, three), (3, secret), (4, "")]
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    got = named(kept)
    assert sorted(set(got), key=str) == got and set(want) - {(3, secret)} <= set(got) and (None, one) not in got and (None, "") not in got and (5, None) not in got
    clean = named(corpus_pipeline.decontaminate(spark, docs, sf_dir))
    assert clean == sorted((r for r in rows if item not in (r[1] or "")), key=str)
    cut = corpus_pipeline.secrets(spark, docs, sf_dir)
    assert cut.columns == docs.columns
    texts = named(cut)
    assert len(texts) == len(rows) and not any("x9" in (t or "") or "bob" in (t or "") for _, t in texts)
    assert {t for _, t in texts} >= {one, two, three, "", None}
    assert corpus_pipeline.encode(spark, docs, sf_dir).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), sf_dir).count() == 0


def test_reply_order_equals_brute_force(spark):
    """Random conversations whose messages quote earlier ones, nested and rewrapped, against a plain parser and tree walk."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    rows, want = [], {}
    for conv in range(6):
        own, up = {}, {}
        for turn in range(25):
            own[turn] = [" ".join(word() for _ in range(6)) for _ in range(3)]
            if turn and rnd.random() < 0.8:
                up[turn] = rnd.randrange(turn)
            lines = []
            if turn in up:
                above = up[turn]
                lines = [f"> {x}" for x in own[above][: rnd.randint(1, 3)]]
                if above in up:
                    lines = [f"> > {x}" for x in own[up[above]]] + lines
            rows.append((conv, turn, "user", "\n".join(lines + own[turn])))

        def walk(t, root, depth, out, up=up):
            out.append((t, root, depth))
            for c in sorted(x for x in up if up[x] == t):
                walk(c, root, depth + 1, out)

        for t in own:
            if t not in up:
                out: list = []
                walk(t, t, 0, out)
                for place, (x, root, depth) in enumerate(out):
                    want[conv, x] = (up.get(x), root, depth, place, "\n".join(own[x]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit("clash"), "id": F.lit("clash"), "body": F.lit("clash")}).repartition(3)
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread_root, r.thread_depth, r.place, r.body) for r in quotes.reply_order(df).collect()}
    assert got == want


def test_quotes_ties_and_long_texts(spark):
    long = "\n".join(f"line number {i} of a long message" for i in range(5000))
    rows = [(1, 0, "same words here"), (1, 1, "same words here"), (1, 2, "> same words here\nok"), (2, 0, long), (2, 1, "> line number 4999 of a long message\nyes")]
    got = {(c, t): (r.reply_to, r.place) for r in quotes.reply_order(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect() for c, t in [(r.conv_id, r.turn)]}
    assert got[1, 2] == (1, 1) and got[2, 1] == (0, 1) and got[1, 0] == (None, 0)


def test_decontamination_equals_all_pairs(spark):
    """Items with a shared opening: every pair that a three-word seed and the alignment of whole texts find is found, and no other."""
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(900)]
    opening = "which of the following statements is true".split()
    items = [(i, " ".join(opening + rnd.choices(vocabulary, k=rnd.randint(8, 40)))) for i in range(250)]
    docs = []
    for i in range(120):
        words = rnd.choices(vocabulary, k=rnd.randint(0, 120))
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = opening  # the opening alone is no copy
        if i % 3 == 1:
            copy = rnd.choice(items)[1].split()
            for k in rnd.sample(range(len(copy)), len(copy) // rnd.choice([3, 4, 8])):
                copy[k] = rnd.choice(vocabulary)
            words[len(words) // 2 : len(words) // 2] = copy
        docs.append((i, " ".join(words)))
    want = set()
    for d, text in docs:
        w = text.split()
        seeds = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
        for i, item in items:
            own = item.split()
            if seeds & {tuple(own[k : k + 3]) for k in range(len(own) - 2)}:
                score, same, width = decontaminate.align(own, w)
                if score >= len(own) or (same >= 10 and same >= 0.4 * len(own) and same >= 0.8 * width):
                    want.add((d, i))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len({d for d, _ in want}) > 20


def test_near_copies_meet_by_fingerprint_first(spark, monkeypatch):
    asked = []
    own = shingles.links_within
    monkeypatch.setattr(shingles, "links_within", lambda points, *more: asked.append(points.count()) or own(points, *more))
    base = [f"word{i}" for i in range(400)]
    texts = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(5, 395, 30)] + [f"another text of its own {i} with words{i}" for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    points = shingles.prefixes(docs, 5).groupBy("h").agg(F.first("fp").alias("fp")).cache()
    fps = {r.h: r.fp & (1 << 64) - 1 for r in points.collect()}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    least = least_of(sorted(fps), links)
    got = sorted((r.a, r.b) for r in shingles.starred(points).collect())
    assert links and got == sorted((a, b) for b, a in least.items() if a != b)
    asked.clear()
    assert {r.component_id for r in shingles.near_copies(docs).filter("doc_id < 13").collect()} == {0}
    assert asked == [len(set(fps.values()))]


def test_workers_let_the_coder_go_when_another_stage_begins(spark, monkeypatch):
    """Python workers outlive a stage: what encode keeps in them must not stay there through the stages of the next run."""
    import weakref

    import corpus_pipeline
    import public_tokenizers

    from leafwise.llm import bpe, quality

    docs = spark.createDataFrame([(i, f"text {i} of some words and user: me{i} host: a.example.com password: x{i}y" * 3) for i in range(12)], "doc_id long, text string").coalesce(1)
    labels, items = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality"), docs.selectExpr("doc_id AS item_id", "text").limit(2)
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: {"labels": labels, "benchmark": items}[name])
    ran, whole = {}, type(docs).mapInArrow

    def noted(df, f, *more, **named):
        ran.setdefault(stage, []).append(f)
        return whole(df, f, *more, **named)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    monkeypatch.setattr(quality, "held_out_rows", lambda *a: F.lit(False))
    for stage, f in corpus_pipeline.STAGES:
        f(spark, docs, "").collect()
    assert list(ran) == [name for name, _ in corpus_pipeline.STAGES]
    path = public_tokenizers.path("word_bpe_49k.json")
    for stage, tasks in ran.items():
        for task in tasks if stage != "encode" else tasks[:1]:
            coder = weakref.ref(bpe.coder_of(path))
            list(task(iter(())))
            assert (coder() is None) == (stage != "encode"), stage


def test_unlike_points_of_dense_keys_and_long_sets_make_no_pairs(spark):
    rng = np.random.default_rng(5)
    # 60 points of one key whose sets share nothing else: before, each two of them were a pair that was written and then judged.
    sets = [np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(59)]
    sets.append(np.sort(np.concatenate([sets[0][:195], rng.integers(0, 1 << 63, 5, dtype=np.uint64)])))
    rows = [(i, len(s), [int(x) for x in shingles.parities(s)]) for i, s in enumerate(sets)]
    points = spark.createDataFrame(rows, "h long, n long, bits array<long>").cache()
    shared = points.selectExpr("1L AS k", "h", "n", "0L AS pos", "h AS component")
    assert [(r.a, r.b) for r in shingles._meetings(points, shared).collect()] == [(0, 59)]
    # Long sets: the short bitmaps allow unlike ones, the wide ones do not; bitmaps of any two lengths never show more than the sets differ in.
    long = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (2000, 1900)]
    seen = lambda bitmap, x, y: shingles.least_difference(bitmap(x), bitmap(y))
    assert 9 * seen(shingles.parities, *long) <= sum(map(len, long)) < 9 * seen(shingles.wide_parities, *long)
    for n, m in ((0, 3), (1, 1), (250, 270), (500, 640), (2000, 1700)):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: m // 2], rng.integers(0, 1 << 63, m - m // 2, dtype=np.uint64)]))
        assert seen(shingles.wide_parities, x, y) <= len(np.setxor1d(x, y))
    words = [f"w{i}" for i in range(4000)]
    docs = spark.createDataFrame([(0, " ".join(words[:2000])), (1, " ".join(words[1000:3000])), (2, " ".join(["x", *words[:2000]]))], "doc_id long, text string")
    points = shingles.prefixes(docs, 5).select("h", F.struct("doc_id", "t").alias("rep"), "n", "bits").cache()
    h = {r.rep.doc_id: r.h for r in points.collect()}
    pairs = spark.createDataFrame([(h[0], h[1]), (h[0], h[2])], "a long, b long")
    assert [(r.a, r.b) for r in shingles._left_by_bitmaps(docs, points, pairs, 5).collect()] == [(h[0], h[2])]
