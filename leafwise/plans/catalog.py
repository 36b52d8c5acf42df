"""Registered queries of the document-content operators, each over its whole tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafwise.functions import identity
from leafwise.functions import text as T
from leafwise.operators import context as C
from leafwise.operators import figures, ledger, metrics, project, reconcile, render, sections
from leafwise.sources.html import page_blocks
from leafwise.sources.shared import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BLOCKS = r"""
WITH bare AS (
  SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g') AS h FROM pages),
parts AS (
  SELECT page_id, string_split(regexp_replace(h, '(?is)<(/?(?:title|h1|p|li|footer|nav|ul|article|head|body|html|br)\b)', chr(1) || '<\1', 'g'), chr(1)) AS a FROM bare),
part AS (SELECT page_id AS doc_id, unnest(a) AS part, generate_subscripts(a, 1) - 1 AS block_seq FROM parts),
tagged AS (
  SELECT doc_id, block_seq, lower(regexp_extract(part, '(?is)^<(title|h1|p|li|footer)\b[^>]*>(.*)$', 1)) AS tag,
         regexp_replace(regexp_extract(part, '(?is)^<(title|h1|p|li|footer)\b[^>]*>(.*)$', 2), '<[^>]*>', '', 'g') AS raw FROM part),
blocks AS (
  SELECT doc_id, CAST(block_seq AS INT) AS block_seq, tag,
         CASE tag WHEN 'title' THEN 'header' WHEN 'footer' THEN 'footer' WHEN 'li' THEN 'list' ELSE 'text' END AS type,
         regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&copy;', '©'), '&nbsp;', chr(160)), '&ensp;', chr(8194)), '&emsp;', chr(8195)), '&thinsp;', chr(8201)), '&ndash;', '–'), '&mdash;', '—'), '&middot;', '·'), '&hellip;', '…'), '&times;', '×'), '&deg;', '°'), '&plusmn;', '±'), '&amp;', '&'),
                        '^[\s\x{a0}\x{2028}\x{2029}\x1c-\x1f]+|[\s\x{a0}\x{2028}\x{2029}\x1c-\x1f]+$', '', 'g') AS own,
         CAST(block_seq // 10 AS INT) AS page_idx
  FROM tagged WHERE tag <> '')
"""


@query(BLOCKS + "SELECT doc_id, block_seq, type, own AS text, CASE WHEN tag = 'h1' THEN 1 END AS text_level, page_idx FROM blocks")
def page_blocks_query(spark, sf_dir):
    """HTML to blocks."""
    out = page_blocks(table(spark, sf_dir, "pages"))
    return out.select("doc_id", "block_seq", "type", F.coalesce("text", F.get("list_items", 0)).alias("text"), "text_level", "page_idx")


_PROJECTED = "SELECT doc_id, block_seq, own AS text, page_idx + 1 AS page_number, {kind} AS type FROM blocks WHERE own <> '' {where}"


@query(BLOCKS + _PROJECTED.format(kind="CAST(NULL AS VARCHAR)", where="AND type NOT IN ('header', 'footer')"))
def project_plain(spark, sf_dir):
    """Plain projection without types."""
    return project.project(page_blocks(table(spark, sf_dir, "pages")))


_TYPED = "CASE WHEN tag = 'h1' THEN 'title' WHEN type IN ('header', 'footer') THEN type END"


@query(BLOCKS + _PROJECTED.format(kind=_TYPED, where=""))
def project_chunk_type(spark, sf_dir):
    """Plain projection with types."""
    return project.project(page_blocks(table(spark, sf_dir, "pages")), chunk_type=True)


def _figure_blocks(spark, sf_dir) -> DataFrame:
    """Every list entry of the pages as a figure with its text as caption; each third has no image file."""
    b = page_blocks(table(spark, sf_dir, "pages"))
    fig = F.col("type") == "list"
    own = F.get("list_items", 0)
    return b.withColumns({
        "img_path": F.when(fig & (F.col("block_seq") % 3 != 0), F.concat(F.lit("f"), "block_seq")),
        "img_caption": F.when(fig, F.array(own)),
        "stored_text": F.when(fig & (F.col("block_seq") % 2 == 0), F.concat(F.lit(" "), own, F.lit(" seen "))),
        "image_seq": F.when(fig & (F.col("block_seq") % 3 == 1), F.col("block_seq")),
        "type": F.when(fig, "image").otherwise(F.col("type")),
        "list_items": F.lit(None).cast("array<string>"),
    })


_IMAGES = """
SELECT doc_id, block_seq, text, page_idx + 1 AS page_number, CASE WHEN tag = 'li' THEN 'image' ELSE {typed} END AS type FROM (
  SELECT *, CASE WHEN tag = 'li' THEN {image} ELSE nullif(own, '') END AS text FROM blocks) WHERE text IS NOT NULL"""


@query(BLOCKS + _IMAGES.format(typed=_TYPED, image="CASE WHEN block_seq % 3 <> 0 THEN CASE WHEN block_seq % 2 = 0 THEN ltrim(own || ' seen') END ELSE nullif(own, '') END"))
def project_images_mode(spark, sf_dir):
    """Stored texts of figures take the place of captions."""
    return project.project(_figure_blocks(spark, sf_dir), mode="images", chunk_type=True)


@query(BLOCKS + _IMAGES.format(typed=_TYPED, image="CASE WHEN block_seq % 3 = 1 THEN concat_ws(chr(10), nullif(own, ''), 'v' || block_seq) ELSE nullif(own, '') END"))
def project_two_stage(spark, sf_dir):
    """Answers are joined to their figures; a figure with a number must have one."""
    b = _figure_blocks(spark, sf_dir)
    results = b.filter("image_seq IS NOT NULL").select("doc_id", "image_seq", F.concat(F.lit("v"), "image_seq").alias("vision_text"))
    return project.project(project.merge_vision(b, results), mode="two_stage", chunk_type=True)


@query(BLOCKS + """, chunks AS (SELECT doc_id, block_seq, own || CASE WHEN tag = 'h1' THEN chr(10) || chr(10) ELSE chr(10) END AS piece FROM blocks WHERE own <> '')
SELECT p.page_id AS doc_id, regexp_replace(coalesce(string_agg(piece, '' ORDER BY block_seq), ''), '\\n+$', '') AS txt, count(piece) AS n_chunks
FROM pages p LEFT JOIN chunks c ON c.doc_id = p.page_id GROUP BY 1""".replace("\\\\n", "\\n"))  # fmt: skip
def plain_text_per_page(spark, sf_dir):
    """Ordered plain text and chunk count of every page."""
    pages = table(spark, sf_dir, "pages")
    chunks = project.project(page_blocks(pages), chunk_type=True)
    return render.plain_text(chunks, pages.select(F.col("page_id").alias("doc_id")))


@query(BLOCKS + """SELECT doc_id, string_agg(CASE WHEN tag = 'h1' THEN '## ' || own WHEN tag = 'li' THEN '- ' || own ELSE own END, chr(10) || chr(10) ORDER BY block_seq) AS markdown
FROM blocks WHERE own <> '' GROUP BY doc_id""")  # fmt: skip
def markdown_per_page(spark, sf_dir):
    """Markdown of every page."""
    return render.markdown(page_blocks(table(spark, sf_dir, "pages")))


def _lines(spark, sf_dir) -> DataFrame:
    """Documents' lines as text blocks, fifty to a page; every seventh is a heading."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_seq", "text"))
    return docs.withColumns({"type": F.lit("text"), "page_idx": F.floor(F.col("block_seq") / 50).cast("int"), "text_level": F.when(F.col("block_seq") % 7 == 0, 1)})


_LINES = """WITH arr AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, unnest(a) AS text, CAST(generate_subscripts(a, 1) - 1 AS INT) AS block_seq FROM arr)
"""


@query(_LINES + "SELECT doc_id, block_seq, text, CAST(block_seq // 50 + 1 AS INT) AS page_number, CASE WHEN block_seq % 7 = 0 THEN 'title' END AS type FROM lines WHERE trim(text) <> ''")
def doc_lines_chunks(spark, sf_dir):
    """Documents' lines as chunks."""
    return project.project(_lines(spark, sf_dir), chunk_type=True)


#: A heading of each kind and others between them, by the line's number; real headings are rare in the documents.
_HEADED = ("Methods", "References", "2. Results", "IV. Data availability:", "Outlook", "Acknowledgements")


def _articles(spark, sf_dir) -> DataFrame:
    """Documents' lines, where every seventh is a heading."""
    names = F.array(*map(F.lit, _HEADED))
    return _lines(spark, sf_dir).withColumn("text", F.when(F.col("text_level").isNotNull(), F.get(names, F.pmod(F.col("doc_id") + F.col("block_seq") / 7, F.lit(6)).cast("int"))).otherwise(F.col("text")))


@query(_LINES + """, headed AS (SELECT doc_id, block_seq, CASE WHEN block_seq % 7 = 0 THEN ['Methods', 'References', '2. Results', 'IV. Data availability:', 'Outlook', 'Acknowledgements'][CAST((doc_id + block_seq // 7) % 6 AS INT) + 1] ELSE text END AS text FROM lines)
SELECT doc_id, block_seq, text FROM (
  SELECT *, last_value(CASE WHEN block_seq % 7 = 0 THEN text IN ('References', 'IV. Data availability:', 'Acknowledgements') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_seq ROWS UNBOUNDED PRECEDING) AS gone FROM headed)
WHERE NOT gone""")  # fmt: skip
def section_filter(spark, sf_dir):
    """Sections under back-matter headings are left out."""
    return sections.without_sections(_articles(spark, sf_dir)).select("doc_id", "block_seq", "text")


@query(_LINES + """, headed AS (SELECT doc_id, block_seq, block_seq % 7 = 0 AS title, CASE WHEN block_seq % 7 = 0 THEN ['Methods', 'References', '2. Results', 'IV. Data availability:', 'Outlook', 'Acknowledgements'][CAST((doc_id + block_seq // 7) % 6 AS INT) + 1] ELSE text END AS text FROM lines),
kept AS (SELECT * FROM (SELECT *, last_value(CASE WHEN title THEN text IN ('References', 'IV. Data availability:', 'Acknowledgements') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_seq ROWS UNBOUNDED PRECEDING) AS gone FROM headed) WHERE NOT gone)
SELECT doc_id, block_seq, text, CAST(block_seq // 50 + 1 AS INT) AS page_number, CASE WHEN title THEN 'title' END AS type FROM kept WHERE trim(text) <> ''""")  # fmt: skip
def article_chunks(spark, sf_dir):
    """Articles without their back matter, as chunks; equations take every third line that is no heading."""
    kept = sections.without_sections(_articles(spark, sf_dir))
    return project.project_articles(kept.withColumn("type", F.when((F.col("block_seq") % 3 == 0) & F.col("text_level").isNull(), "equation").otherwise("text")))


@query("SELECT lower(regexp_replace(l, '^\\s+|\\s+$', '', 'g')) AS heading, regexp_matches(lower(regexp_replace(l, '^\\s+|\\s+$', '', 'g')), '^\\s*([ivxlcdm]+\\.?|\\d+\\.?|\\w+\\.?)?\\s*(acknowledge?ments?|author\\s+contributions?|bibliography|conflict\\s+of\\s+interest|credit\\s+authorship\\s+contribution\\s+statement|data\\s+availability|declaration\\s+of\\s+competing\\s+interest|declaration\\s+of\\s+interests?|declarations?|literature\\s+cited|online|r\\s+e\\s+f\\s+e\\s+r\\s+e\\s+n\\s+c\\s+e\\s+s|references?)\\s*[:.]?\\s*$') AS dropped, count(*) AS n FROM (SELECT p_type || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN ' References' ELSE ' ' || p_brand END AS l FROM part UNION ALL SELECT p_size || '. References' FROM part UNION ALL SELECT 'IV. Data availability:' FROM part) WHERE l IS NOT NULL GROUP BY 1, 2")
def heading_filter(spark, sf_dir):
    """Which headings open a section that is left out."""
    p = table(spark, sf_dir, "part")
    suffix = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, " References").otherwise(F.concat(F.lit(" "), "p_brand"))
    l = p.select(F.concat("p_type", suffix).alias("l")).unionByName(p.select(F.concat("p_size", F.lit(". References")).alias("l"))).unionByName(p.select(F.lit("IV. Data availability:").alias("l")))  # noqa: E741
    return l.filter("l IS NOT NULL").groupBy(F.lower(T.strip("l")).alias("heading"), T.is_dropped_heading("l").alias("dropped")).agg(F.count("*").alias("n"))


def _turns(spark, sf_dir) -> DataFrame:
    """Messages with every fifth emptied; system and first messages count as titles."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "").otherwise(F.regexp_replace("text", "\n", " ")).alias("text"))
    return t.withColumn("line", F.when(F.col("text") != "", C.context_line(F.col("text"), F.floor(F.col("turn") / 2), F.col("turn") == 0)))


_TURNS = """WITH turns AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 5 = 0 THEN '' ELSE replace(text, chr(10), ' ') END AS text FROM conversations),
numbered AS (SELECT *, '[Page ' || (turn // 2 + 1) || '] [ChunkType=' || CASE WHEN turn = 0 THEN 'Title' ELSE 'Body' END || '] ' || text AS line,
  CAST(text <> '' AS INT) AS self, CAST(sum(CAST(text <> '' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS INT) AS k FROM turns),
arr AS (SELECT conv_id, list(line ORDER BY turn) AS ls FROM numbered WHERE text <> '' GROUP BY 1),
met AS (SELECT n.conv_id, n.turn, n.role,
  coalesce(array_to_string(list_slice(ls, greatest(k - self - 2, 0) + 1, k - self), chr(10)), '') AS before,
  coalesce(array_to_string(list_slice(ls, k + 1, k + 2), chr(10)), '') AS after
  FROM numbered n LEFT JOIN arr ON arr.conv_id = n.conv_id WHERE n.role = 'assistant')
"""


def _context(spark, sf_dir) -> DataFrame:
    return C.context(_turns(spark, sf_dir), group="conv_id", order="turn", line="line", at=F.col("role") == "assistant")


@query(_TURNS + "SELECT conv_id, turn, before, after FROM met")
def context_window(spark, sf_dir):
    """Two non-empty messages before and after each answer."""
    return _context(spark, sf_dir).select("conv_id", "turn", "before", "after")


@query(_TURNS + """SELECT conv_id, turn, concat_ws(chr(10), 'Image caption (Page ' || (turn // 2 + 1) || '): ' || role,
  CASE WHEN trim(before) <> '' THEN 'Context before: ' || before END, CASE WHEN trim(after) <> '' THEN 'Context after: ' || after END) AS prompt FROM met""")  # fmt: skip
def context_prompt(spark, sf_dir):
    """The prompt made of an answer's surroundings, with the place of its caption."""
    got = _context(spark, sf_dir)
    return got.select("conv_id", "turn", C.prompt(F.col("role"), F.lit(""), F.col("before"), F.col("after"), F.floor(F.col("turn") / 2)).alias("prompt"))


@query("""WITH keyed AS (SELECT source, doc_id, sha256('2' || chr(0) || sha256(coalesce(text, '')) || chr(0) || coalesce(lang, '')) AS key FROM documents),
firsts AS (SELECT *, min(doc_id) OVER (PARTITION BY source, key) AS f FROM keyed)
SELECT source, doc_id, key, CAST(dense_rank() OVER (PARTITION BY source ORDER BY f) AS INT) AS image_seq FROM firsts""")  # fmt: skip
def request_key_dedup(spark, sf_dir):
    """Equal texts of a source are one request, numbered by first use."""
    d = table(spark, sf_dir, "documents")
    keyed = d.select("source", "doc_id", figures.request_key(F.sha2(F.coalesce("text", F.lit("")), 256), F.coalesce("lang", F.lit(""))).alias("key"))
    return figures.first_seen_numbers(keyed, group="source", order="doc_id", key="key", slices=1024).select("source", "doc_id", "key", "image_seq")


@query("SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NOT NULL THEN coalesce(CAST(l.quality AS VARCHAR), '-') || '/' || coalesce(CAST(l.toxic AS VARCHAR), '-') END AS vision_text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def merge_results(spark, sf_dir):
    """Results joined to their documents, which are figures with the document's number as theirs."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("block_seq"), "lang", F.col("doc_id").cast("int").alias("image_seq"))
    results = table(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").cast("int").alias("image_seq"), F.concat_ws("/", F.coalesce(F.col("quality").cast("string"), F.lit("-")), F.coalesce(F.col("toxic").cast("string"), F.lit("-"))).alias("vision_text"))
    return project.merge_vision(d, results).select("doc_id", "lang", "vision_text")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_results(spark, sf_dir):
    """Documents without a result."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return figures.pending(d, table(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT p_partkey, CASE
  WHEN p_size / 2000.0 < CASE WHEN p_partkey % 3 = 0 THEN 0.005 ELSE 0.01 END THEN 'area'
  WHEN p_retailprice / 100.0 > 10 THEN 'box_aspect'
  WHEN greatest(p_size * 8, 100) / CAST(least(p_size * 8, 100) AS DOUBLE) > 10 THEN 'aspect'
  WHEN p_partkey % 3 <> 0 AND least(p_size * 8, 100) < 96 THEN 'side'
  WHEN p_partkey % 3 <> 0 AND p_size * 8 * 100 < 9216 THEN 'pixels'
  WHEN p_partkey % 3 <> 0 AND p_partkey * 100 < 10240 THEN 'bytes' END AS skip_reason FROM part""")  # fmt: skip
def figure_selection(spark, sf_dir):
    """The first rule by which a figure is left out."""
    p = table(spark, sf_dir, "part")
    reason = figures.skip_reason(area_ratio=F.col("p_size") / 2000.0, box_aspect=F.col("p_retailprice") / 100.0, width=F.col("p_size") * 8, height=F.lit(100), size=F.col("p_partkey") * 100, captioned=F.col("p_partkey") % 3 == 0)
    return p.select("p_partkey", reason.alias("skip_reason"))


@query("""SELECT p_partkey AS doc_id, CASE p_size % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'text' WHEN 2 THEN 'list' WHEN 3 THEN 'text' WHEN 4 THEN 'table' ELSE 'image' END AS type,
  CASE WHEN p_size % 6 = 1 THEN p_name ELSE p_type END AS text,
  CASE WHEN p_size % 6 IN (0, 5) THEN p_brand || '|' || p_name END AS caption,
  CASE WHEN p_partkey % 5 < 4 THEN p_size * (500 + p_partkey % 5) / 1000 ELSE CAST(p_size AS DOUBLE) END AS x FROM part""")  # fmt: skip
def normalize_types(spark, sf_dir):
    """Parser types to block types, generated bodies to captions, boxes to points."""
    p = table(spark, sf_dir, "part")
    names = F.array(*map(F.lit, ("chart", "code", "index", "page_footnote", "table", "image")))
    b = p.select(
        F.col("p_partkey").alias("doc_id"), F.lit(0).alias("block_seq"), F.get(names, F.col("p_size") % 6).alias("type"), F.col("p_type").alias("text"),
        F.when(F.col("p_size") % 6 == 0, F.array("p_brand")).alias("chart_caption"), F.when(F.col("p_size") % 6 == 5, F.array("p_brand")).alias("image_caption"),
        F.col("p_name").alias("content"), F.col("p_name").alias("code_body"), (F.col("p_partkey") % 5).cast("int").alias("page_idx"),
        F.array(*[F.col("p_size").cast("double")] * 4).alias("bbox"),
    )
    pages = p.filter(F.col("p_partkey") % 5 < 4).select(F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 5).cast("int").alias("page_idx"), (500.0 + F.col("p_partkey") % 5).alias("width_pt"), F.lit(800.0).alias("height_pt"))
    out = project.normalize(b, pages)
    return out.select("doc_id", "type", "text", F.when(F.col("type") == "image", F.array_join("img_caption", "|")).alias("caption"), F.get("bbox", 0).alias("x"))


@query("SELECT p_partkey, contains(p_name || CASE p_partkey % 4 WHEN 0 THEN '☐' WHEN 1 THEN '☑' ELSE '' END, '☐') OR p_partkey % 4 = 1 AS marked FROM part")
def checkbox_gate(spark, sf_dir):
    """Whether any field holds a checkbox."""
    p = table(spark, sf_dir, "part")
    mark = F.when(F.col("p_partkey") % 4 == 0, "☐").when(F.col("p_partkey") % 4 == 1, "☑").otherwise("")
    return p.select("p_partkey", reconcile.has_mark(F.concat("p_name", mark), F.col("p_type")).alias("marked"))


@query("""WITH t AS (SELECT p_size AS page, p_partkey AS target, string_split(p_brand || ' ' || p_type || ' ' || p_brand, ' ') AS a FROM part),
tl AS (SELECT page, target, unnest(a) AS label, generate_subscripts(a, 1) AS nr FROM t),
tn AS (SELECT page, target, nr, regexp_replace(label, '^[ :;,]+|[ :;,]+$', '', 'g') AS l FROM tl),
s AS (SELECT DISTINCT p_size AS page, p_partkey AS row_nr, unnest(string_split(p_type, ' ')) AS label FROM part UNION SELECT DISTINCT p_size, p_partkey, string_split(p_brand || ' ' || p_type, ' ')[1] FROM part),
sl AS (SELECT page, row_nr, regexp_replace(label, '^[ :;,]+|[ :;,]+$', '', 'g') AS l FROM s),
score AS (SELECT tn.page, tn.target, sl.row_nr, count(DISTINCT tn.nr) AS score FROM tn JOIN sl ON tn.page = sl.page AND tn.l <> '' AND sl.l <> ''
  AND (tn.l = sl.l OR (length(sl.l) >= 4 AND starts_with(tn.l, sl.l)) OR (length(tn.l) >= 4 AND starts_with(sl.l, tn.l))) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY page, target ORDER BY score DESC, row_nr) AS r FROM score),
size AS (SELECT page, target, count(*) AS n FROM tn WHERE l <> '' GROUP BY ALL)
SELECT b.page, b.target, b.row_nr, b.score FROM best b JOIN size USING (page, target) WHERE r = 1 AND score >= least(2, n)""")  # fmt: skip
def label_match_best_row(spark, sf_dir):
    """For each part's words (the brand twice) the part of the same size that fits most of them."""
    p = table(spark, sf_dir, "part")
    words = F.split(F.concat_ws(" ", "p_brand", "p_type", "p_brand"), " ")
    targets = p.select(F.col("p_size").alias("page"), F.col("p_partkey").alias("target"), F.posexplode(words).alias("entry_nr", "label"))
    sources = p.select(F.col("p_size").alias("page"), F.col("p_partkey").alias("row_nr"), F.explode(F.split("p_type", " ")).alias("label")).unionByName(p.select(F.col("p_size").alias("page"), F.col("p_partkey").alias("row_nr"), F.get(words, 0).alias("label"))).distinct()
    return reconcile.best_rows(targets, sources, page=["page"], target="target")


@query("""WITH w AS (SELECT p_partkey, string_split(p_type || ' ' || p_name, ' ') AS a, p_partkey % 2 = 0 AS b1, p_partkey % 3 = 0 AS b2, p_partkey % 5 = 0 AS b3 FROM part WHERE len(string_split(p_type || ' ' || p_name, ' ')) >= 3)
SELECT p_partkey, '<table><tr><th>Finish</th></tr><tr><td>' || CASE WHEN b1 THEN '☑' ELSE '☐' END || a[1] || ' ' || CASE WHEN b2 THEN '☑' ELSE '☐' END || a[2] || ' ' || CASE WHEN b3 THEN '☑' ELSE '☐' END || a[3] || '</td></tr></table>' AS text,
  CAST(CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE CAST(b1 AS INT) END + CAST(b2 AS INT) + CAST(b3 AS INT) AS INT) AS n_changes FROM w""")  # fmt: skip
def checkbox_repair(spark, sf_dir):
    """Each part's words as unmarked options of a table row, every seventh without its first mark, set right by positional words."""
    p = table(spark, sf_dir, "part").withColumn("a", F.split(F.concat_ws(" ", "p_type", "p_name"), " ")).filter(F.size("a") >= 3)
    on = lambda i: F.col("p_partkey") % (2, 3, 5)[i] == 0
    words = p.select("p_partkey", F.posexplode(F.array(*[F.concat(F.when(on(i), "■").otherwise("□"), F.get("a", i)) for i in range(3)])).alias("at", "text"))
    words = words.select("p_partkey", F.lit(20.0).alias("y_min"), F.col("at").cast("double").alias("x_min"), "text")
    sources = reconcile.source_entries(reconcile.visual_rows(words, page=["p_partkey"]), page=["p_partkey"])
    first = F.when(F.col("p_partkey") % 7 == 0, "").otherwise("☐")
    cell = F.concat(first, F.get("a", 0), F.lit(" ☐"), F.get("a", 1), F.lit(" ☐"), F.get("a", 2))
    values = p.select("p_partkey", F.lit(0).alias("nr"), F.concat(F.lit("<table><tr><th>Finish</th></tr><tr><td>"), cell, F.lit("</td></tr></table>")).alias("text"))
    return reconcile.repair(values, sources, page=["p_partkey"], target="nr", path=shared_folder(spark, "repair")).select("p_partkey", "text", "n_changes")


@query("""WITH RECURSIVE w AS (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events WHERE value IS NOT NULL),
f(user_id, k, anchor, row_nr, event_id) AS (
  SELECT user_id, k, value, 0, event_id FROM w WHERE k = 1
  UNION ALL SELECT w.user_id, w.k, CASE WHEN abs(f.anchor - w.value) <= 3.0 THEN f.anchor ELSE w.value END, f.row_nr + CASE WHEN abs(f.anchor - w.value) <= 3.0 THEN 0 ELSE 1 END, w.event_id
  FROM f JOIN w ON w.user_id = f.user_id AND w.k = f.k + 1)
SELECT user_id, row_nr, count(*) AS n_words, string_agg(event_id, ' ' ORDER BY event_id) AS words FROM f GROUP BY ALL""")  # fmt: skip
def visual_rows(spark, sf_dir):
    """Events of a user as words whose value is their height, folded into rows by anchor."""
    e = table(spark, sf_dir, "events").filter("value IS NOT NULL").select("user_id", F.col("value").alias("y_min"), F.col("event_id").cast("double").alias("x_min"), F.col("event_id").cast("string").alias("text"))
    rows = reconcile.visual_rows(e, page=["user_id"])
    return rows.select("user_id", "row_nr", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words"))


@query("""WITH w AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<think>so' || chr(10) || 'it is</think>' || chr(10) || 'Here is the summary:' || chr(10) WHEN 1 THEN 'Image Description: [Page 2] [ChunkType=Image]' || chr(10) ELSE '' END || 'x ' || coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(t, '(?is)^\\s*<think>.*?</think>\\s*', '') AS t FROM w),
b AS (SELECT doc_id, regexp_replace(t, '(?i)^\\s*(?:Here (?:is|are) (?:the |a )?(?:summary|analysis|key findings))[：:,，]\\s*', '') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)^\\s*Image Description:\\s*', ''), '(?i)\\[Page\\s+\\d+\\]', '', 'g'), '(?i)\\[ChunkType=[^\\]]+\\]', '', 'g') AS t FROM b)
SELECT doc_id, regexp_replace(regexp_replace(t, '[ \\t]*(\\n)[ \\t]*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM c""".replace("\\\\", "\\"))  # fmt: skip
def sanitize_chain(spark, sf_dir):
    """Wrappers taken off the documents' whole texts, and every line stripped."""
    d = table(spark, sf_dir, "documents")
    wrap = F.when(F.col("doc_id") % 3 == 0, "<think>so\nit is</think>\nHere is the summary:\n").when(F.col("doc_id") % 3 == 1, "Image Description: [Page 2] [ChunkType=Image]\n").otherwise("")
    return d.select("doc_id", T.sanitize(F.concat(wrap, F.lit("x "), F.coalesce("text", F.lit("")))).alias("clean"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
f AS (SELECT doc_id, list_filter(['licen[sc]e', 'password'], lambda p: NOT regexp_matches(x, '(?i)' || p)) AS m, list_filter(['all rights reserved', 'confidential'], lambda p: regexp_matches(x, '(?i)' || p)) AS g FROM t)
SELECT doc_id, array_to_string(m, '|') AS missing, array_to_string(g, '|') AS forbidden, len(m) = 0 AND len(g) = 0 AS ok FROM f""")  # fmt: skip
def pattern_check(spark, sf_dir):
    """Required patterns that each document lacks and forbidden ones that it holds."""
    d = table(spark, sf_dir, "documents").select("doc_id", metrics.pattern_faults(F.col("text"), required=["licen[sc]e", "password"], forbidden=["all rights reserved", "confidential"]).alias("f"))
    return d.select("doc_id", F.array_join("f.missing", "|").alias("missing"), F.array_join("f.forbidden", "|").alias("forbidden"), F.col("f.ok").alias("ok"))


@query("SELECT event_type AS endpoint, count(*) AS requests, count(*) FILTER (WHERE coalesce(value > 50, false)) AS passed, CAST(sum(user_id) AS BIGINT) AS completion_tokens FROM events GROUP BY 1")
def endpoint_report(spark, sf_dir):
    """Requests, passes and tokens of each endpoint."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), (F.col("value") > 50).alias("ok"), F.col("user_id").cast("long").alias("completion_tokens"))
    return metrics.endpoint_report(e)


@query("SELECT doc_id, CAST(sum(length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'))) AS BIGINT) AS n_letters, sum(length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'))) >= 32 AS has_text FROM documents GROUP BY 1".replace("\\\\", "\\"))
def text_layer(spark, sf_dir):
    """Letters of each document, and whether they are enough to be text."""
    return metrics.has_text_layer(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("SELECT doc_id AS key, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE NOT (doc_id % 4 <> 0 AND doc_id % 3 <> 0)")
def journal_resume(spark, sf_dir):
    """What a second run has to submit: new inputs, and those whose content has changed."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    earlier = d.filter(F.col("key") % 4 != 0).select("key", F.when(F.col("key") % 3 == 0, "old").otherwise(F.col("sha256")).alias("sha256"), F.lit("SUCCESS").alias("state"))
    return ledger.to_submit(d, earlier)


def _messages(spark, sf_dir) -> DataFrame:
    """Events as messages of jobs (users); their generation rises and falls."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("job_id"), "event_id", "ts", (F.col("event_id") % 7).alias("generation"), F.col("event_type").alias("state"))


@query("SELECT user_id AS job_id, event_id, CAST(generation AS BIGINT) AS generation FROM (SELECT *, event_id % 7 AS generation, max(event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events) WHERE generation >= g")
def generation_fence(spark, sf_dir):
    """Messages of no older generation than those before them."""
    return ledger.fence(_messages(spark, sf_dir), order="event_id").select("job_id", "event_id", "generation")


@query("SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_messages FROM events GROUP BY 1")
def job_state_latest(spark, sf_dir):
    """The last state of each job."""
    return ledger.latest_state(_messages(spark, sf_dir), order=["ts", "event_id"])


@query("""SELECT user_id AS key, event_id, CASE WHEN row_number() OVER w = 1 THEN 'created' WHEN first_value(event_type) OVER w = event_type THEN 'same' ELSE 'conflict' END AS outcome
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")  # fmt: skip
def create_once(spark, sf_dir):
    """The first request of a key makes the job; others are the same or in conflict."""
    m = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", F.col("event_type").alias("fingerprint"))
    return ledger.create_once(m, order="event_id").select("key", "event_id", "outcome")


@query("SELECT event_type AS queue, count(*) FILTER (WHERE user_id % 2 = 0) AS urgent, count(*) FILTER (WHERE user_id % 2 <> 0) AS normal, count(*) AS total FROM events GROUP BY 1")
def queue_depth(spark, sf_dir):
    """Messages of each queue by priority."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("queue"), F.when(F.col("user_id") % 2 == 0, "urgent").otherwise("normal").alias("priority"))
    return ledger.queue_depth(e, queue="queue", priority="priority", priorities=["urgent", "normal"])


@query("SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'F' AND epoch(TIMESTAMP '1998-08-02') - floor(epoch(o_orderdate)) >= 86400 * 1000")
def retention_candidates(spark, sf_dir):
    """Finished orders of a thousand days or more ago."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("STARTED").alias("state"), F.col("o_orderdate").alias("updated_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    return ledger.collectable(o, now=F.lit("1998-08-02 00:00:00").cast("timestamp"), retention_s=86400 * 1000).select("job_id")


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50, median(value) AS middle FROM events GROUP BY 1")
def latency_nearest_rank(spark, sf_dir):
    """Nearest-rank percentiles and the median."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(metrics.nearest_rank("value", 0.95).alias("p95"), metrics.nearest_rank("value", 0.5).alias("p50"), F.median("value").alias("middle"))


@query("SELECT event_type, list_sort(list(value))[CAST(floor((count(value) - 1) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_floor_index(spark, sf_dir):
    """The other percentile: the value at a floored index."""
    return metrics.floor_index(table(spark, sf_dir, "events"), group="event_type", value="value", p=0.95, name="p95")


@query("SELECT *, CASE WHEN seconds > 0 THEN total / CAST(seconds AS DOUBLE) END AS per_second FROM (SELECT event_type, count(*) AS total, CAST(max(floor(epoch(ts))) - min(floor(epoch(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1)")
def throughput(spark, sf_dir):
    """Events, seconds, and events a second of each kind."""
    e = table(spark, sf_dir, "events").withColumn("one", F.lit(1).cast("long"))
    return metrics.throughput(e, group="event_type", amount="one", start="ts", stop="ts")


@query("SELECT user_id, event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 3 AS INT) AS slot FROM events")
def round_robin(spark, sf_dir):
    """Events of a user dealt over three slots."""
    return ledger.round_robin(table(spark, sf_dir, "events"), within="user_id", order="event_id", n=3).select("user_id", "event_id", "slot")


@query("SELECT event_type, user_id, n AS pending FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n, user_id) AS r FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE r = 1")
def least_pending(spark, sf_dir):
    """The user with the fewest events of each kind."""
    loads = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("pending"))
    return ledger.least_pending(loads, group="event_type", worker="user_id", pending="pending")


@query("SELECT source, doc_id FROM (SELECT d.source, d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS r FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)) WHERE r <= 32")
def wave_limit(spark, sf_dir):
    """The first 32 documents of each source that have no label yet (the wave is the feature)."""
    d, done = table(spark, sf_dir, "documents").select("source", "doc_id"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    return figures.pending(d, d.join(done, "doc_id", "left_semi"), ["source", "doc_id"], wave=32)


@query("SELECT CAST(row_number() OVER (ORDER BY c, s_suppkey, p) - 1 AS INT) AS position, s_suppkey AS source_index, CAST(p AS INT) AS source_page FROM (SELECT c, s_suppkey, unnest(generate_series(0, CAST(s_suppkey % 3 AS INT))) AS p FROM supplier, range(4) r(c)) QUALIFY position < 250")
def case_builder(spark, sf_dir):
    """The pages of the suppliers' files, over and over, up to 250 (the limit is the feature)."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_index"), (F.col("s_suppkey") % 3 + 1).cast("int").alias("n_pages"))
    return metrics.case_pages(s, pages=250, cycles=4)


@query("""SELECT coalesce(string_agg(DISTINCT nullif(ext, ''), ', ' ORDER BY nullif(ext, '')), '') AS extensions, count(*) AS n FROM (SELECT lower(regexp_extract(coalesce(url, ''), '(\\.[^./\\\\?#]+)(?:[?#].*)?$', 1)) AS ext FROM pages)""".replace("\\\\", "\\"))
def extension_list(spark, sf_dir):
    """Distinct extensions of all pages' addresses."""
    ext = table(spark, sf_dir, "pages").select(T.extension(F.coalesce("url", F.lit(""))).alias("ext"))
    return ext.agg(T.extension_list(F.collect_set("ext")).alias("extensions"), F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n_files, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS n_bytes FROM documents GROUP BY 1")
def dry_run_summary(spark, sf_dir):
    """Files and bytes of each kind."""
    return metrics.file_summary(table(spark, sf_dir, "documents"), kind="lang", size=F.octet_length(F.coalesce("text", F.lit(""))))


@query("""WITH b AS (SELECT CASE o_orderkey % 8 WHEN 0 THEN 'pipeline' WHEN 1 THEN ' VLM-http' WHEN 2 THEN 'Flash' WHEN 3 THEN 'basic' WHEN 4 THEN 'advanced ' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE o_orderpriority END AS backend FROM orders)
SELECT backend, CASE WHEN lower(trim(backend)) IN ('flash', 'basic', 'standard', 'advanced') THEN lower(trim(backend)) WHEN lower(trim(backend)) = 'pipeline' THEN 'basic'
  WHEN lower(trim(backend)) LIKE 'vlm-%' OR coalesce(trim(backend), '') = '' THEN 'advanced' ELSE 'standard' END AS tier, count(*) AS n FROM b GROUP BY 1, 2""")  # fmt: skip
def tier_names(spark, sf_dir):
    """Tier names, older backend names and unknown ones (priorities) to tiers."""
    o = table(spark, sf_dir, "orders")
    names = F.array(*map(F.lit, ("pipeline", " VLM-http", "Flash", "basic", "advanced ", "", None)))
    backend = F.when(F.col("o_orderkey") % 8 == 7, F.col("o_orderpriority")).otherwise(F.get(names, (F.col("o_orderkey") % 8).cast("int")))
    return o.groupBy(backend.alias("backend"), T.tier(backend).alias("tier")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, r_name, CAST(repetition AS BIGINT) AS repetition, CAST('0x' || substr(sha256('42' || chr(0) || c_custkey || chr(0) || r_name || chr(0) || repetition), 1, 15) AS BIGINT) AS rank FROM customer, region, range(3) t(repetition)""")
def request_plan(spark, sf_dir):
    """Every customer with every region, three times, in a seeded order."""
    c, r = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "region").select("r_name")
    return metrics.request_plan(c, r, repetitions=3, seed=42).withColumn("repetition", F.col("repetition").cast("long"))


@query("""WITH j AS (SELECT o_orderkey AS job_id, list_sort([o_orderkey % 3, o_orderkey % 5 + 3, o_orderkey % 7 + 6]) AS k FROM orders)
SELECT job_id, ['PENDING', 'STARTED', 'SUCCESS'][CAST(job_id % 3 AS INT) + 1] AS last_named,
  CASE job_id % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'STARTED' ELSE 'EXPIRED' END AS state, CASE job_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS n_applied, CASE job_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 1 END AS n_rejected FROM j""")  # fmt: skip
def job_moves(spark, sf_dir):
    """Each order as a job with messages of which some are no legal moves."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    # pending only; started and then thrown back; finished, failed too late, collected
    told = {0: ["PENDING", "EXPIRED", "EXPIRED"], 1: ["PENDING", "STARTED", "PENDING", "EXPIRED"], 2: ["PENDING", "STARTED", "SUCCESS", "FAILURE", "EXPIRED"]}
    lists = F.when(F.col("job_id") % 3 == 0, F.array(*map(F.lit, told[0]))).when(F.col("job_id") % 3 == 1, F.array(*map(F.lit, told[1]))).otherwise(F.array(*map(F.lit, told[2])))
    messages = o.select("job_id", F.posexplode(lists).alias("ts", "state"))
    named = F.get(F.array(*map(F.lit, ("PENDING", "STARTED", "SUCCESS"))), (F.col("job_id") % 3).cast("int"))
    return ledger.apply_moves(messages, order=["ts"]).select("job_id", named.alias("last_named"), "state", F.col("n_applied").cast("int").alias("n_applied"), F.col("n_rejected").cast("int").alias("n_rejected"))


@query("""SELECT o_orderkey AS job_id, CAST(o_custkey % 4 AS INT) AS generation FROM orders o WHERE o_orderkey % 3 <> 0""")
def outbox_recovery(spark, sf_dir):
    """Orders whose publication has no receipt of its newest generation; every order was published before under an older one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 4).cast("int").alias("generation"))
    outbox = o.unionByName(o.select("job_id", (F.col("generation") - 1).alias("generation")))
    receipts = o.filter(F.col("job_id") % 3 == 0).unionByName(o.filter(F.col("job_id") % 2 == 0).select("job_id", (F.col("generation") - 1).alias("generation")))
    return ledger.unpublished(outbox, receipts)


@query("""SELECT l_orderkey AS doc_id, count(*) AS images_total, count(*) FILTER (WHERE l_linenumber % 3 <> 0) AS images_completed, CASE WHEN count(*) FILTER (WHERE l_linenumber % 3 = 0) > 0 THEN 'vision' ELSE 'merge' END AS stage FROM lineitem GROUP BY 1""")
def vision_progress(spark, sf_dir):
    """Lines of orders as figures of documents, two thirds of them answered."""
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("image_seq"))
    return ledger.progress(asked, asked.filter(F.col("image_seq") % 3 != 0), ["doc_id", "image_seq"])


@query("""SELECT s_suppkey AS job_id, CASE s_suppkey % 5 WHEN 1 THEN 'content' WHEN 2 THEN 'missing' WHEN 3 THEN 'version' WHEN 4 THEN 'path' END AS fault FROM supplier""")
def checkpoint_faults(spark, sf_dir):
    """Checkpoints of two parts for each supplier: whole, changed, lost, of another version, or outside their folder."""
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("job_id"), F.explode(F.array(F.lit("a.json"), F.lit("b.json"))).alias("path"), "s_name")
    kind, second = F.col("job_id") % 5, F.col("path") == "b.json"
    path = F.when((kind == 4) & second, "../b.json").otherwise(F.col("path"))
    manifest = p.select("job_id", F.when(kind == 3, 2).otherwise(1).alias("version"), path.alias("path"), F.sha2("s_name", 256).alias("sha256"))
    parts = p.filter(~((kind == 2) & second)).select("job_id", path.alias("path"), F.when((kind == 1) & second, F.concat("s_name", F.lit("?"))).otherwise(F.col("s_name")).alias("content"))
    return ledger.checked_parts(manifest, parts)


@query("""SELECT c_custkey, sha256('{"acct": ' || CAST(c_nationkey AS VARCHAR) || ', "name": "' || c_name || '"}') AS profile, 'q.' || CASE c_custkey % 2 WHEN 0 THEN 'parse_urgent' ELSE 'merge' END AS queue FROM customer""")
def profile_and_route(spark, sf_dir):
    """The hash of each customer's settings in canonical form, and the queue of its work."""
    c = table(spark, sf_dir, "customer")
    settings = F.create_map(F.lit("name"), identity.json_string(F.col("c_name")), F.lit("acct"), F.col("c_nationkey").cast("string"))
    even = F.col("c_custkey") % 2 == 0
    queue = ledger.route(F.when(even, "urgent").otherwise("normal"), F.when(even, "parse").otherwise("merge"), {"parse": "q.parse", "merge": "q.merge"})
    return c.select("c_custkey", ledger.profile_sha(settings).alias("profile"), queue.alias("queue"))


@query("""SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][CAST(('0x' || substr(h, 17, 1))::INT % 4 AS INT) + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS job_id
FROM (SELECT c_custkey, lower(sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode('parse' || chr(0) || c_name))) AS h FROM customer)""")  # fmt: skip
def job_ids(spark, sf_dir):
    """The version-5 UUID of each customer's name."""
    return table(spark, sf_dir, "customer").select("c_custkey", identity.job_id("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.lit("parse"), F.col("c_name")).alias("job_id"))


def _form_blocks(spark, sf_dir) -> DataFrame:
    """Parts as blocks of documents by size: tables, equations, figures with captions and notes, lists, texts."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_type", "p_brand")
    kind = F.get(F.array(*map(F.lit, ("table", "equation", "image", "list", "text"))), (F.col("p_partkey") % 5).cast("int"))
    image, tab = kind == "image", kind == "table"
    return p.select(
        F.col("p_size").cast("int").alias("doc_id"), F.col("p_partkey").cast("int").alias("block_seq"), kind.alias("type"),
        F.when(kind.isin("equation", "text"), F.col("p_name")).alias("text"), F.when(F.col("p_partkey") % 3 == 0, 1).alias("text_level"), F.lit(0).alias("page_idx"),
        F.when(kind == "list", F.split("p_type", " ")).alias("list_items"),
        F.when(tab, F.array("p_brand")).alias("table_caption"), F.when(tab, F.col("p_name")).alias("table_body"), F.when(tab & (F.col("p_partkey") % 2 == 0), F.array("p_type")).alias("table_footnote"),
        F.when(image & (F.col("p_partkey") % 4 != 0), F.col("p_type")).alias("img_path"), F.when(image & (F.col("p_partkey") % 3 != 0), F.array("p_brand")).alias("img_caption"), F.when(image, F.array("p_type")).alias("img_footnote"),
    )


_FORMS = """WITH b AS (SELECT p_size AS doc_id, p_partkey AS block_seq, ['table', 'equation', 'image', 'list', 'text'][CAST(p_partkey % 5 AS INT) + 1] AS type, p_partkey AS k, p_name, p_type, p_brand FROM part),
said AS (SELECT *, CASE type WHEN 'table' THEN p_brand || chr(10) || p_name || CASE WHEN k % 2 = 0 THEN chr(10) || p_type ELSE '' END WHEN 'list' THEN replace(p_type, ' ', chr(10))
  WHEN 'image' THEN CASE WHEN k % 3 <> 0 THEN p_brand || chr(10) ELSE '' END || p_type ELSE p_name END AS said, type IN ('equation', 'text', 'list') AND k % 3 = 0 AS title FROM b)
"""


@query(_FORMS + "SELECT CAST(doc_id AS INT) AS doc_id, CAST(block_seq AS INT) AS block_seq, said AS text, 1 AS page_number, CASE WHEN type = 'text' AND k % 3 = 0 THEN 'title' END AS type FROM said")
def project_forms(spark, sf_dir):
    """Tables, equations, captioned figures and lists as chunks."""
    return project.project(_form_blocks(spark, sf_dir), chunk_type=True)


@query(_FORMS + """, lined AS (SELECT *, '[Page 1] [ChunkType=' || CASE WHEN title THEN 'Title' ELSE 'Body' END || '] ' || said AS line, '[ChunkType=' || CASE WHEN title THEN 'Title' ELSE 'Body' END || '] ' || said AS bare FROM said),
near AS (SELECT *, concat_ws(chr(10), lag(line, 2) OVER w, lag(line) OVER w) AS before, concat_ws(chr(10), lead(line) OVER w, lead(line, 2) OVER w) AS after,
  concat_ws(chr(10), lag(bare, 2) OVER w, lag(bare) OVER w) AS bare_before, concat_ws(chr(10), lead(bare) OVER w, lead(bare, 2) OVER w) AS bare_after FROM lined WINDOW w AS (PARTITION BY doc_id ORDER BY block_seq)),
asked AS (SELECT *, CASE WHEN k % 3 <> 0 THEN 'Image caption (Page 1): ' || p_brand || chr(10) ELSE '' END || 'Image footnote (Page 1): ' || p_type || CASE WHEN before <> '' THEN chr(10) || 'Context before: ' || before ELSE '' END || CASE WHEN after <> '' THEN chr(10) || 'Context after: ' || after ELSE '' END AS prompt,
  sha256('2' || chr(0) || sha256(p_type) || chr(0) || CASE WHEN k % 3 <> 0 THEN 'Image caption: ' || p_brand || chr(10) ELSE '' END || 'Image footnote: ' || p_type || CASE WHEN bare_before <> '' THEN chr(10) || 'Context before: ' || bare_before ELSE '' END || CASE WHEN bare_after <> '' THEN chr(10) || 'Context after: ' || bare_after ELSE '' END) AS key
  FROM near WHERE type = 'image' AND k % 4 <> 0)
SELECT CAST(doc_id AS INT) AS doc_id, CAST(block_seq AS INT) AS block_seq, prompt, key, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY f) AS INT) AS image_seq FROM (SELECT *, min(block_seq) OVER (PARTITION BY doc_id, key) AS f FROM asked)""")  # fmt: skip
def image_jobs(spark, sf_dir):
    """The figures that a model is asked about, with prompts, keys and numbers."""
    blocks = _form_blocks(spark, sf_dir)
    files = blocks.filter("img_path IS NOT NULL").select("doc_id", "img_path").distinct().select("doc_id", "img_path", F.sha2("img_path", 256).alias("sha256"), F.lit(400).alias("width"), F.lit(300).alias("height"), F.lit(50_000).alias("size"))
    return figures.image_jobs(blocks, files).select("doc_id", "block_seq", "prompt", "key", "image_seq")


QUERIES["page_blocks"] = QUERIES.pop("page_blocks_query")
ORACLES["page_blocks"] = ORACLES.pop("page_blocks_query")

from leafwise.plans import helpers, resumed  # noqa: E402, F401 - they register their queries
