"""Registered queries of what goes on over time: streams, durable stages, scans with a cursor, kept answers; and of figure modes and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.functions import text as T
from leafwise.operators import captions, figures, ledger, metrics, project, providers, reconcile, render, stages
from leafwise.plans.catalog import _FORMS, _TYPED, BLOCKS, ORACLES, _form_blocks, query, table
from leafwise.sources import blocks as parsed
from leafwise.sources.html import page_blocks
from leafwise.sources.shared import shared_folder
from leafwise.streaming import ledger as streams
from leafwise.streaming import scan

#: Which state an event tells of its user's job.
TOLD = {"view": "PENDING", "click": "STARTED", "purchase": "SUCCESS", "error": "FAILURE", "signup": "EXPIRED"}
_LEGAL = ", ".join(f"'{a}>{b}'" for a, nexts in ledger.MOVES.items() for b in nexts)
_MOVES = f"""WITH RECURSIVE m AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TOLD.items())} END AS told FROM events),
walk AS (SELECT job_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS state, CAST(0 AS BIGINT) AS n_applied, CAST(0 AS BIGINT) AS n_rejected FROM m WHERE k = 1
  UNION ALL SELECT job_id, k, CASE WHEN legal THEN told ELSE state END, n_applied + CASE WHEN legal THEN 1 ELSE 0 END, n_rejected + CASE WHEN legal THEN 0 ELSE 1 END
  FROM (SELECT w.job_id, m.k, m.told, w.state, w.n_applied, w.n_rejected, CASE WHEN w.state IS NULL THEN m.told = 'PENDING' ELSE w.state = m.told OR (w.state || '>' || m.told) IN ({_LEGAL}) END AS legal FROM walk w JOIN m ON m.job_id = w.job_id AND m.k = w.k + 1))
SELECT job_id, arg_max(state, k) AS state, max(n_applied) AS n_applied, max(n_rejected) AS n_rejected FROM walk GROUP BY 1"""


def _told(spark, sf_dir) -> DataFrame:
    """Events as messages about their users' jobs; each kind of event tells a state."""
    told = F.create_map(*[F.lit(x) for pair in TOLD.items() for x in pair])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", told[F.col("event_type")].alias("state"), (F.col("event_id") % 7).alias("generation"), F.col("event_type").alias("fingerprint"))


def _halves(rows: DataFrame, order: str) -> tuple[Column, Column]:
    """Conditions of the first and second half of the range of `order`."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    middle = F.lit(0 if low is None else (low + high) // 2)
    return F.col(order) <= middle, F.col(order) > middle


@query(_MOVES)
def job_moves_told(spark, sf_dir):
    """The state that each user's job ends in; illegal moves are passed over."""
    return ledger.apply_moves(_told(spark, sf_dir), order=["event_id"])


@query(_MOVES)
def stream_moves(spark, sf_dir):
    """The same by keyed state over a stream that is stopped and started again, with legal and illegal moves in two tables."""
    rows, base = _told(spark, sf_dir), shared_folder(spark, "moves")
    for half in _halves(rows, "event_id"):
        rows.filter(half).write.mode("append").parquet(f"{base}/in")
        moves = streams.moved(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), order="event_id")
        streams.write_split(moves, f"{base}/out", {"applied": "applied", "rejected": "NOT applied"}, checkpoint=f"{base}/cp").awaitTermination()
    good, bad = (spark.read.schema("job_id long, event_id long, state string").parquet(f"{base}/out/{t}") for t in ("applied", "rejected"))
    n_good = good.groupBy("job_id").agg(F.max_by("state", "event_id").alias("state"), F.count("*").alias("n_applied"))
    n_bad = bad.groupBy("job_id").agg(F.count("*").alias("n_rejected"))
    met = n_good.join(n_bad, "job_id", "full")
    return met.select("job_id", "state", F.coalesce("n_applied", F.lit(0)).alias("n_applied"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"))


def _streamed(spark, rows: DataFrame, make, base: str) -> DataFrame:
    """What `make` gives over a stream of `rows` that come in two halves, with a restart between."""
    for half in _halves(rows, "event_id"):
        rows.filter(half).write.mode("append").parquet(f"{base}/in")
        made = make(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        made.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{base}/out")


@query(ORACLES["create_once"])
def stream_creates(spark, sf_dir):
    """Created, same or in conflict, told by keyed state over a stream with a restart."""
    rows = _told(spark, sf_dir).withColumnRenamed("job_id", "key")
    out = _streamed(spark, rows, lambda s: streams.created(s, order="event_id"), shared_folder(spark, "creates"))
    return out.select("key", "event_id", "outcome")


@query(ORACLES["generation_fence"])
def stream_fence(spark, sf_dir):
    """Messages of no older generation than those before, by keyed state over a stream with a restart."""
    out = _streamed(spark, _told(spark, sf_dir), lambda s: streams.fenced(s, order="event_id"), shared_folder(spark, "fence"))
    return out.select("job_id", "event_id", "generation")


@query("""SELECT o_orderkey AS job_id, o_custkey % 4 AS generation, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'uncertain' ELSE 'pending' END AS handoff,
  CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END AS n_sent FROM orders""")  # fmt: skip
def outbox_handoff(spark, sf_dir):
    """Orders as messages: finished ones are published, over a failure between sending and receipt that the stream replays; open ones are sent and left without a receipt; others wait."""
    box = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 4).alias("generation"), "o_orderstatus")
    base, fail = shared_folder(spark, "outbox"), {"n": 1}

    def send(rows: DataFrame, ident: str) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/sent/id={ident}")
        if fail["n"]:
            fail["n"] -= 1
            raise ConnectionError("the receipt was lost")

    def publish() -> None:
        stream = spark.readStream.schema(box.schema).parquet(f"{base}/in")
        try:
            streams.publish(stream, f"{base}/out", send, checkpoint=f"{base}/cp").awaitTermination()
        except Exception as e:  # noqa: BLE001 - only the failure made above is passed over
            if "the receipt was lost" not in str(e):
                raise

    box.filter("o_orderstatus = 'F'").write.parquet(f"{base}/in")
    publish()
    publish()  # replays the batch that failed
    box.filter("o_orderstatus = 'O'").write.mode("append").parquet(f"{base}/in")
    fail["n"] = 1
    publish()
    keys = "job_id long, generation long"
    states = ledger.handoff(box, *(spark.read.schema(keys).parquet(f"{base}/out/{t}") for t in ("claims", "receipts")))
    sent = spark.read.schema(keys).parquet(f"{base}/out/sent").groupBy("job_id", "generation").agg(F.count("*").alias("n_sent"))
    return states.join(sent, ["job_id", "generation"], "left").select("job_id", "generation", "handoff", F.coalesce("n_sent", F.lit(0)).cast("int").alias("n_sent"))


_PARTS = 8


@query(BLOCKS + f""", chunks AS (SELECT doc_id, block_seq, own || CASE WHEN tag = 'h1' THEN chr(10) || chr(10) ELSE chr(10) END AS piece FROM blocks WHERE own <> '')
SELECT p.page_id AS doc_id, regexp_replace(coalesce(string_agg(piece, '' ORDER BY block_seq), ''), '\\n+$', '') || CASE WHEN p.page_id % {_PARTS} = 5 THEN ' (second edition)' ELSE '' END AS txt,
  CASE p.page_id % {_PARTS} WHEN 3 THEN 'damaged' WHEN 5 THEN 'changed' ELSE 'kept' END AS part_was, CASE WHEN p.page_id % {_PARTS} IN (3, 5) THEN 2 ELSE 1 END AS made_by_run
FROM pages p LEFT JOIN chunks c ON c.doc_id = p.page_id GROUP BY p.page_id""")  # fmt: skip
def durable_stages(spark, sf_dir):
    """Parse and assemble as durable stages, run twice: between the runs one part is damaged and one has new input, and only those are made again."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html", (F.col("page_id") % _PARTS).cast("int").alias("part"), F.lit("").alias("edition"))
    base = shared_folder(spark, "stages")

    def parse(rows: DataFrame) -> DataFrame:
        chunks = project.project(page_blocks(rows), chunk_type=True)
        return rows.select(F.col("page_id").alias("doc_id"), "part", "edition").join(chunks, "doc_id", "left")

    def assemble(rows: DataFrame) -> DataFrame:
        named = rows.select("doc_id", "part", "edition").distinct()
        return named.join(render.plain_text(rows.filter("block_seq IS NOT NULL"), named), "doc_id").select("doc_id", F.concat("txt", "edition").alias("txt"), "part")

    def run(given: DataFrame) -> DataFrame:
        return stages.stage(stages.stage(given, parse, f"{base}/parse"), assemble, f"{base}/assemble")

    run(pages)
    run_one = spark.createDataFrame([("forged", 1)], "txt string, _run int").withColumn("doc_id", F.lit(-1).cast("long"))
    run_one.write.mode("append").parquet(f"{base}/assemble/data/part=3")
    edition = F.when(F.col("part") == 5, " (second edition)").otherwise("")
    last = run(pages.withColumn("edition", edition))
    log = stages.manifest(spark, f"{base}/assemble", "part", "int").select("part", F.col("run").alias("made_by_run"))
    was = F.when(F.col("part") == 3, "damaged").when(F.col("part") == 5, "changed").otherwise("kept")
    return last.join(log, "part").select("doc_id", "txt", was.alias("part_was"), "made_by_run")


@query("SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n_bytes, CAST(1 AS BIGINT) AS n_seen, CASE WHEN page_id % 6 < 4 THEN 'first' ELSE 'second' END AS run FROM pages")
def cursor_scan(spark, sf_dir):
    """Pages in files that a scan finds a few at a time, over two runs; each page is seen once, in the run after its file came."""
    pages, base = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html")), shared_folder(spark, "scan")
    schema = pages.schema
    for name, condition in (("first", "page_id % 6 < 4"), ("second", "page_id % 6 >= 4")):
        pages.filter(condition).repartition("page_id").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{base}/in")
        scan.scan_on(stream.withColumn("run", F.lit(name)), f"{base}/out", checkpoint=f"{base}/cp").awaitTermination()
    got = spark.read.schema("page_id long, html string, run string, batch int").parquet(f"{base}/out")
    return got.groupBy("page_id", "run").agg(F.max(F.octet_length("html")).cast("long").alias("n_bytes"), F.count("*").alias("n_seen"))


@query(BLOCKS + f"SELECT doc_id, block_seq, own AS text, page_idx + 1 AS page_number, {_TYPED} AS type FROM blocks WHERE own <> '' AND page_idx BETWEEN 1 AND 2 AND doc_id % 2 = 0")
def parsed_pages(spark, sf_dir):
    """Pages two and three of the documents of one tier, through the data source: others are not parsed."""
    base = shared_folder(spark, "parsed")
    tiered = page_blocks(table(spark, sf_dir, "pages")).withColumn("tier", F.when(F.col("doc_id") % 2 == 0, "basic").otherwise("advanced"))
    parsed.write_pages(tiered, f"{base}/pages")
    got = parsed.read_blocks(spark, f"{base}/pages", where="page_idx BETWEEN 1 AND 2 AND tier = 'basic'")
    return project.project(got.withColumn("doc_id", F.col("doc_id").cast("long")), chunk_type=True)


@query(BLOCKS + "SELECT DISTINCT sha256(own) AS key, 'stub' AS provider, 'Figure of ' || length(own) || ' letters' AS answer, CAST(0 AS BIGINT) AS asked_again FROM blocks WHERE tag = 'li'")
def kept_answers(spark, sf_dir):
    """A model is asked about every list entry, in two runs; the second finds all answers of the first."""
    asked = page_blocks(table(spark, sf_dir, "pages")).filter("type = 'list'").select(F.get("list_items", 0).alias("prompt"))
    base = shared_folder(spark, "answers")
    asked = asked.select(F.sha2("prompt", 256).alias("key"), "prompt")
    run = lambda: providers.completions(asked, f"{base}/journal", providers=["stub"], buckets=16)
    run().write.parquet(f"{base}/first")
    before = spark.read.schema("key string, bucket int").json(f"{base}/journal").groupBy("key").agg(F.count("*").alias("n"))
    run().write.parquet(f"{base}/second")
    after = spark.read.schema("key string, bucket int").json(f"{base}/journal").groupBy("key").agg(F.count("*").alias("m"))
    got = spark.read.schema("key string, provider string, answer string").parquet(f"{base}/second")
    return got.join(before, "key").join(after, "key").select("key", "provider", "answer", (F.col("m") - F.col("n")).alias("asked_again"))


#: Figures of the form blocks get boxes on a page of 600 x 800 points and files of sizes that follow from their part.
_BOXED = """, figure AS (SELECT *, k % 29 * 10.0 + 5 AS bw, k % 31 * 4.0 + 3 AS bh, k % 23 * 20 + 20 AS fw, k % 19 * 25 + 15 AS fh, k % 17 * 1500 + 500 AS fs FROM said WHERE type = 'image' AND k % 4 <> 0),
chosen AS (SELECT *, CASE WHEN bw * bh / 480000.0 < 0.005 THEN 'area' WHEN greatest(bw, bh) / least(bw, bh) > 10 THEN 'box_aspect' WHEN greatest(fw, fh) / CAST(least(fw, fh) AS DOUBLE) > 10 THEN 'aspect' END AS captioned_reason FROM figure)
"""


def _boxed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Form blocks whose figures have boxes, and their files; a file belongs to one figure. Every sixth figure has neither caption nor note."""
    k = F.col("block_seq")
    at = F.lit(0.0)
    figure = (F.col("type") == "image") & (k % 4 != 0)
    b = _form_blocks(spark, sf_dir).withColumns({
        "img_path": F.when(figure, F.concat(F.lit("f"), k)), "bbox": F.when(figure, F.array(at, at, (k % 29 * 10 + 5).cast("double"), (k % 31 * 4 + 3).cast("double"))),
        "page_size": F.array(F.lit(600.0), F.lit(800.0)),
        "img_caption": F.when(k % 6 != 0, F.col("img_caption")), "img_footnote": F.when(k % 6 != 0, F.col("img_footnote")),
    })
    files = b.filter(figure).select("doc_id", "img_path", F.sha2("img_path", 256).alias("sha256"), (k % 23 * 20 + 20).alias("width"), (k % 19 * 25 + 15).alias("height"), (k % 17 * 1500 + 500).alias("size"))
    return b, files


@query(_FORMS + _BOXED + """SELECT CAST(doc_id AS INT) AS doc_id, CAST(block_seq AS INT) AS block_seq, reason, reason IS NULL AS selected, true AS in_every FROM (SELECT *, CASE WHEN k % 6 <> 0 THEN captioned_reason ELSE
  CASE WHEN bw * bh / 480000.0 < 0.01 THEN 'area' WHEN captioned_reason IN ('box_aspect', 'aspect') THEN captioned_reason WHEN least(fw, fh) < 96 THEN 'side' WHEN fw * fh < 9216 THEN 'pixels' WHEN fs < 10240 THEN 'bytes' END END AS reason FROM chosen)""")  # fmt: skip
def figure_choice(spark, sf_dir):
    """Why each figure is left out, by its box and its file; which ones are asked about, and that all are in the mode without selection."""
    blocks, files = _boxed(spark, sf_dir)
    own = figures.measures(blocks).filter(figures.with_file(blocks)).join(files, ["doc_id", "img_path"])
    captioned = F.coalesce(F.size("img_caption") > 0, F.lit(False)) | F.coalesce(F.size("img_footnote") > 0, F.lit(False))
    reason = figures.skip_reason(area_ratio=F.col("area_ratio"), box_aspect=F.col("box_aspect"), width=F.col("width"), height=F.col("height"), size=F.col("size"), captioned=captioned)
    some, every = (figures.image_jobs(blocks, files, every=e).select("doc_id", "block_seq", F.lit(True).alias(n)) for e, n in ((False, "selected"), (True, "in_every")))
    met = own.select("doc_id", "block_seq", reason.alias("reason")).join(some, ["doc_id", "block_seq"], "left").join(every, ["doc_id", "block_seq"], "left")
    return met.select("doc_id", "block_seq", "reason", F.coalesce("selected", F.lit(False)).alias("selected"), F.coalesce("in_every", F.lit(False)).alias("in_every"))


@query(_FORMS + """, lined AS (SELECT doc_id, block_seq, type, k, '[Page 1] [ChunkType=' || CASE WHEN title THEN 'Title' ELSE 'Body' END || '] ' || said AS line FROM said WHERE type <> 'image' UNION ALL SELECT doc_id, block_seq, type, k, NULL FROM said WHERE type = 'image' AND k % 4 <> 0),
near AS (SELECT *, list(line) FILTER (WHERE line IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY block_seq ROWS UNBOUNDED PRECEDING) AS up, list(line) FILTER (WHERE line IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY block_seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS down FROM lined),
asked AS (SELECT *, concat_ws(chr(10), 'Context before: ' || nullif(array_to_string(up[-2:], chr(10)), ''), 'Context after: ' || nullif(array_to_string(down[:2], chr(10)), '')) AS prompt FROM near WHERE type = 'image'),
keyed AS (SELECT *, sha256('2' || chr(0) || sha256('f' || k) || chr(0) || prompt) AS key FROM asked)
SELECT CAST(doc_id AS INT) AS doc_id, CAST(block_seq AS INT) AS block_seq, prompt, key, '' AS base_text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_seq) AS INT) AS image_seq FROM keyed""")  # fmt: skip
def figure_strict(spark, sf_dir):
    """Requests for reading off what figures say: without captions and notes, with positions, for all figures."""
    blocks, files = _boxed(spark, sf_dir)
    return figures.image_jobs(blocks, files, every=True, strict=True).select("doc_id", "block_seq", "prompt", "key", "base_text", "image_seq")


@query(_FORMS + """SELECT CAST(doc_id AS INT) AS doc_id, string_agg(CASE type WHEN 'table' THEN p_brand || chr(10) || chr(10) || p_name || CASE WHEN k % 2 = 0 THEN chr(10) || chr(10) || p_type ELSE '' END
  WHEN 'image' THEN CASE WHEN k % 3 <> 0 THEN p_brand || chr(10) || chr(10) ELSE '' END || p_type
  WHEN 'list' THEN '- ' || replace(p_type, ' ', chr(10) || '- ') WHEN 'equation' THEN CASE WHEN k % 3 = 0 THEN '## ' ELSE '' END || p_name ELSE CASE WHEN k % 3 = 0 THEN '## ' ELSE '' END || p_name END, chr(10) || chr(10) ORDER BY block_seq) AS markdown
FROM said GROUP BY doc_id""")  # fmt: skip
def markdown_of_forms(spark, sf_dir):
    """Markdown of documents with tables, figures, equations and lists, written to a file each and read back."""
    base = shared_folder(spark, "markdown")
    render.write_markdown(render.markdown(_form_blocks(spark, sf_dir)), f"{base}/files")
    return render.read_markdown(spark, f"{base}/files").select(F.col("doc_id").cast("int").alias("doc_id"), "markdown")


@query(ORACLES["visual_rows"].replace("user_id", "event_type"))
def visual_rows_of_large_pages(spark, sf_dir):
    """Events of a kind as words of one page, folded into rows over sorted range partitions with the anchor carried over their borders."""
    e = table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_type", F.col("value").alias("y_min"), F.col("event_id").cast("double").alias("x_min"), F.col("event_id").cast("string").alias("text"))
    rows = reconcile.visual_rows(e, page=["event_type"], path=shared_folder(spark, "rows"))
    return rows.select("event_type", "row_nr", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words"))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.999) AS p999 FROM events WHERE value IS NOT NULL GROUP BY 1")
def exact_percentiles(spark, sf_dir):
    """Nearest-rank percentiles by range histograms, without sorting a group or holding its values."""
    e = table(spark, sf_dir, "events")
    return metrics.ranks(e, group="event_type", value="value", shares={"p95": 0.95, "p50": 0.5, "p999": 0.999}, path=shared_folder(spark, "ranks"), few=100)


@query("SELECT l_returnflag, list_sort(list(l_extendedprice))[CAST(floor((count(l_extendedprice) - 1) * 0.9::DOUBLE) AS BIGINT) + 1] AS p90 FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1")
def exact_floor_index(spark, sf_dir):
    """The value at a floored index of the sorted prices of each return flag, by range histograms."""
    return metrics.ranks(table(spark, sf_dir, "lineitem"), group="l_returnflag", value="l_extendedprice", shares={"p90": 0.9}, path=shared_folder(spark, "ranks"), rule="floor", few=100)


_EXTS = ("pdf", ".PNG", " docx", "tiff", "jpg", ".xls", "webp")


@query(f"""WITH w AS (SELECT p_partkey, [{", ".join(f"'.{e.strip().lower().lstrip('.')}'" for e in _EXTS)}] AS e FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct([e[CAST(p_partkey % 7 AS INT) + 1], e[CAST(p_partkey % 5 AS INT) + 1], e[CAST(p_partkey % 3 AS INT) + 1]])), ',') AS formats FROM w""")  # fmt: skip
def format_sets(spark, sf_dir):
    """The formats that a list names, each once, dotted and sorted; all of them supported."""
    named = F.array(*map(F.lit, _EXTS))
    k = F.col("p_partkey")
    wanted = F.array_join(F.array(*(F.get(named, (k % n).cast("int")) for n in (7, 5, 3))), ",")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.chosen_formats(wanted), ",").alias("formats"))


@query("SELECT p_type AS provider, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS models FROM part WHERE p_brand IS NOT NULL GROUP BY 1")
def model_catalog(spark, sf_dir):
    """The distinct models of each provider."""
    return ledger.catalog(table(spark, sf_dir, "part"), group="p_type", name="p_brand").select(F.col("p_type").alias("provider"), F.array_join("models", ",").alias("models"))


@query("SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PENDING' ELSE 'FAILURE' END AS state FROM orders")
def job_listing(spark, sf_dir):
    """Jobs by id as a listing shows them: what went wrong is left out."""
    state = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("FAILURE")
    return ledger.listing(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), state.alias("state"), F.col("o_orderpriority").alias("error")))


@query("""WITH k AS (SELECT p_size AS doc_id, p_partkey AS k, p_name, p_type, p_brand FROM part),
f AS (SELECT doc_id, 'fig' AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS position, CASE WHEN k % 4 <> 0 THEN 'fig:' || p_type END AS label, p_brand || ' [' || p_name || ']' AS caption, p_name || ' "' || k || '"' AS said FROM k WHERE k % 3 = 0),
t AS (SELECT doc_id, 'tbl' AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS position, CASE WHEN k % 4 <> 1 THEN CASE WHEN k % 2 = 0 THEN 'tbl:' ELSE '' END || replace(p_brand, '#', '-') END AS given, p_name AS caption FROM k WHERE k % 3 = 1),
u AS (SELECT doc_id, kind, position, CASE WHEN given IS NULL THEN NULL WHEN starts_with(given, 'tbl:') THEN given ELSE 'tbl:' || given END AS label, caption, NULL AS said FROM t),
b AS (SELECT *, min(position) OVER (PARTITION BY doc_id, kind, coalesce(label, 'at ' || position)) AS first FROM (SELECT * FROM f UNION ALL SELECT * FROM u)),
n AS (SELECT *, CASE WHEN kind = 'tbl' OR label IS NOT NULL THEN dense_rank() OVER (PARTITION BY doc_id, kind, kind = 'fig' AND label IS NULL ORDER BY first) END AS number FROM b)
SELECT CAST(doc_id AS INT) AS doc_id, kind, CAST(position AS INT) AS position, CASE WHEN kind = 'tbl' THEN coalesce(label, 'tbl:' || number) ELSE label END AS label, caption, said, CAST(number AS INT) AS number FROM n""")  # fmt: skip
def caption_labels(spark, sf_dir):
    """Figures and tables of Markdown texts that are made of parts: labels, numbers by first use, captions, and a quoted attribute."""
    k = F.col("p_partkey")
    brand = F.col("p_brand")
    figure = F.concat(F.lit("!["), brand, F.lit(" ["), "p_name", F.lit("]](f.png){"), F.when(k % 4 != 0, F.concat(F.lit("#fig:"), "p_type")).otherwise(""), F.lit(" .c alt='"), "p_name", F.lit(' "'), k, F.lit("\"'}"))
    label = F.when(k % 4 != 1, F.concat(F.lit(" {#"), F.when(k % 2 == 0, "tbl:").otherwise(""), F.regexp_replace(brand, "#", "-"), F.lit("}"))).otherwise("")
    tabled = F.concat(F.lit(": "), "p_name", label, F.lit("\n\n| x |\n"))
    line = F.when(k % 3 == 0, figure).when(k % 3 == 1, tabled).otherwise(F.col("p_name"))
    docs = table(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.struct(k, line.alias("line")).alias("l")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n\n").alias("text"))
    found = captions.with_captions(docs)
    figs = found.select("doc_id", F.lit("fig").alias("kind"), F.posexplode("figures").alias("position", "x")).select("doc_id", "kind", "position", "x.label", "x.caption", F.try_element_at("x.pairs", F.lit("alt")).alias("said"), "x.number")
    tabs = found.select("doc_id", F.lit("tbl").alias("kind"), F.posexplode("tables").alias("position", "x")).select("doc_id", "kind", "position", "x.label", "x.caption", F.lit(None).cast("string").alias("said"), "x.number")
    return figs.unionByName(tabs)
