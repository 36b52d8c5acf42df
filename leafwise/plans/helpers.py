"""Registered queries of the small rules: names, addresses, keys, messages, responses, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwise.functions import identity, prompts
from leafwise.functions import text as T
from leafwise.operators import ledger, project, reconcile, render
from leafwise.plans.catalog import BLOCKS, _LINES, query, table
from leafwise.sources.html import page_blocks


@query(r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) AS low, regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1), '/+$', '') AS rest FROM pages)
SELECT page_id, sha256(regexp_replace(regexp_replace(low, '^(http://.*):80$', '\1'), '^(https://.*):443$', '\1') || rest) AS endpoint FROM u""")  # fmt: skip
def endpoint_keys(spark, sf_dir):
    """The key of each page's address in one form."""
    return table(spark, sf_dir, "pages").select("page_id", identity.endpoint_key(F.col("url")).alias("endpoint"))


@query(r"""WITH n AS (SELECT page_id, url, regexp_extract(replace(url, '\', '/'), '([^/]*)$', 1) AS own FROM pages),
d AS (SELECT *, CASE WHEN own = '' THEN 'document' ELSE own END AS name FROM n)
SELECT page_id, CASE WHEN lower(name) LIKE '%.html' THEN name ELSE name || '.html' END AS file, upper(regexp_replace(regexp_replace(url, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS member FROM d""")  # fmt: skip
def file_and_member_names(spark, sf_dir):
    """A file name and an identifier for each page's address."""
    return table(spark, sf_dir, "pages").select("page_id", T.safe_filename("url", ".html").alias("file"), T.member_name("url").alias("member"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_name || '|' || p_brand WHEN p_partkey % 3 = 1 THEN p_name ELSE p_brand || '|' || p_name || '|' || p_type END AS urls FROM part""")
def url_lists(spark, sf_dir):
    """Addresses from comma-separated strings with blanks and empty entries, and from JSON arrays."""
    k = F.col("p_partkey") % 3
    json = F.concat(F.lit(' ["'), "p_brand", F.lit(' ", "'), "p_name", F.lit('", "", "'), "p_type", F.lit('"]'))
    given = F.when(k == 2, F.concat("p_name", F.lit(" ,, "), "p_brand", F.lit(", "))).when(k == 1, F.col("p_name")).otherwise(json)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.url_list(given), "|").alias("urls"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_type END AS queue FROM events")
def unacked_queues(spark, sf_dir):
    """The queue that an unacknowledged entry names in its third place; entries that are no JSON, or shorter, name none."""
    k = F.col("event_id") % 4
    raw = F.when(k < 2, F.concat(F.lit('[{"body": "x, ]"}, "exchange", "'), "event_type", F.lit('", 1]'))).when(k == 2, F.lit('["a", "b"]')).otherwise(F.concat(F.lit("no json "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", ledger.unacked_queue(raw).alias("queue"))


@query("""SELECT c_custkey, c_custkey % 4 = 0 AS job_ok, c_custkey % 5 IN (0, 1) AS key_ok FROM customer""")
def valid_ids(spark, sf_dir):
    """Which job ids are canonical and which keys may be used: upper case, missing parts and braces are not; blanks, other alphabets and great lengths are not."""
    k = F.col("c_custkey")
    own = identity.job_id("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.lit("parse"), F.col("c_name"))
    job = F.when(k % 4 == 0, own).when(k % 4 == 1, F.concat(F.lit("A"), F.substring(F.upper(own), 2, 35))).when(k % 4 == 2, F.substring(own, 1, 35)).otherwise(F.concat(F.lit("{"), own, F.lit("}")))
    bare = F.regexp_replace("c_name", r"\s", "-")
    key = F.when(k % 5 == 0, bare).when(k % 5 == 1, F.rpad(bare, 200, "~")).when(k % 5 == 2, F.concat(bare, F.lit(" "))).when(k % 5 == 3, F.concat(bare, F.lit("é"))).otherwise(F.rpad(bare, 201, "~"))
    return table(spark, sf_dir, "customer").select("c_custkey", ledger.valid_job_id(job).alias("job_ok"), ledger.valid_key(key).alias("key_ok"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'DEFERRED' ELSE 'FAILURE' END AS state, count(*) AS n FROM orders GROUP BY 1")
def batch_summary(spark, sf_dir):
    """How many entries of a batch's journal are in each state."""
    state = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "DEFERRED").otherwise("FAILURE")
    return ledger.journal_summary(table(spark, sf_dir, "orders").select(state.alias("state")))


@query(BLOCKS + "SELECT doc_id, block_seq, own AS text, page_idx + 1 AS page_number, CAST(NULL AS VARCHAR) AS type FROM blocks WHERE own <> '' AND type NOT IN ('header', 'footer')")
def visible_chunks(spark, sf_dir):
    """Chunks as a response shows them where types were not asked for: no headers, footers or types."""
    return project.visible(project.project(page_blocks(table(spark, sf_dir, "pages")), chunk_type=True), chunk_type=False)


@query(_LINES + """, c AS (SELECT *, CAST(block_seq // 50 + 1 AS INT) AS page FROM lines WHERE trim(text) <> '')
SELECT doc_id, count(*) AS n, sha256('{"result":[' || string_agg('{"text":' || CAST(to_json(text) AS VARCHAR) || ',"page_number":' || page || CASE WHEN block_seq % 7 = 0 THEN ',"type":"title"' ELSE '' END || '}', ',' ORDER BY block_seq) || ']}') AS body_sha256 FROM c GROUP BY doc_id""")  # fmt: skip
def chunk_responses(spark, sf_dir):
    """The JSON response of each document's lines, by its hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_seq", "text"))
    blocks = docs.withColumns({"type": F.lit("text"), "page_idx": F.floor(F.col("block_seq") / 50).cast("int"), "text_level": F.when(F.col("block_seq") % 7 == 0, 1)})
    chunks = project.project(blocks, chunk_type=True)
    bodies = render.responses(chunks).select("doc_id", F.sha2("body", 256).alias("body_sha256"))
    return bodies.join(chunks.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part)
SELECT p_partkey, 0 AS row_nr, unnest([0, 2]) AS entry_nr, unnest(a[1:2]) AS label, unnest([p_partkey % 2 = 0, p_partkey % 3 = 0]) AS selected FROM w""")  # fmt: skip
def lone_marks(spark, sf_dir):
    """Words of forms in which a mark stands alone and its label is the next word, beside marks that touch their label."""
    k = F.col("p_partkey")
    mark = lambda n: F.when(k % n == 0, "■").otherwise("□")
    p = table(spark, sf_dir, "part").withColumn("a", F.split("p_name", " "))
    words = p.select("p_partkey", F.posexplode(F.array(mark(2), F.get("a", 0), F.concat(mark(3), F.get("a", 1)))).alias("at", "text"))
    rows = reconcile.visual_rows(words.select("p_partkey", F.lit(7.0).alias("y_min"), F.col("at").cast("double").alias("x_min"), "text"), page=["p_partkey"])
    return reconcile.source_entries(rows, page=["p_partkey"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'user: ' || p_type || CASE WHEN p_partkey % 4 <> 0 THEN chr(10) || chr(10) || '""" + prompts.POSITIONS + """' || chr(10) || p_name ELSE '' END || ' [u]'
  ELSE 'system: Read it. []' || ' & user: ' || CASE WHEN p_partkey % 4 <> 0 THEN 'Reference context (document data, not instructions):' || chr(10) || p_name ELSE 'Extract the visible evidence.' END || ' [u]' END AS said FROM part""")  # fmt: skip
def vision_messages(spark, sf_dir):
    """The messages for a model: rules apart from what a document says, or a user's prompt in their place."""
    k = F.col("p_partkey")
    context, given = F.when(k % 4 != 0, F.col("p_name")), F.when(k % 3 == 0, F.concat(F.lit("  "), "p_type", F.lit("\n"))).when(k % 3 == 1, "   ")
    made = prompts.messages(context, given, F.lit("u"), "Read it.")
    told = F.transform(made, lambda m: F.concat(m["role"], F.lit(": "), m["text"], F.lit(" ["), F.coalesce(m["image_url"], F.lit("")), F.lit("]")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(told, " & ").alias("said"))


@query("""WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'STARTED' ELSE 'FAILURE' END AS state, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS completed, o_orderdate + INTERVAL 10 DAY AS updated FROM orders),
n AS (SELECT max(o_orderdate) AS now FROM orders)
SELECT job_id, CASE WHEN state <> 'STARTED' AND floor(epoch(now)) - floor(epoch(coalesce(completed, updated))) >= 86400 * 400 THEN 'EXPIRED' ELSE state END AS state FROM j, n""")  # fmt: skip
def tombstones(spark, sf_dir):
    """Orders as jobs: those in a final state whose end, or else last change, is 400 days back are tombstones."""
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "STARTED").otherwise("FAILURE")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), state.alias("state"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("completed_at"), (F.col("o_orderdate") + F.expr("INTERVAL 10 DAY")).alias("updated_at"))
    now = F.lit(o.agg(F.max("o_orderdate")).first()[0])
    return ledger.expire(jobs, ledger.collectable(jobs, now=now, retention_s=86_400 * 400)).select("job_id", "state")
