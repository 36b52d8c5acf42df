"""Secret scans with multipart credential linking (operator 4).

Base kinds are found on their own. Weak parts (an access identifier, a short or
plain secret, an endpoint) mean nothing alone: an interval join over the
document gives each weak part the scope around it, and the part is reported
only if the scope holds complementary parts.

The join is linear. Parts are summed up to the first start and the last end of
each role in each bin of a document that they lie in; a weak part looks at the
bins that its scope touches. A scope is at least as wide as two bins, so each bin
lies inside it or sticks out on one side only, where the first start or the last
end decides exactly.

Defined results: a null text counts as empty; empty texts have no spans and the
hash of no bytes; texts and values of any length are scanned whole; repeated
rows give repeated rows; null and repeated doc_ids are as good as others, as
rows are told apart; an empty table gives an empty result; further columns of
the input are not read, and redact() returns them as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, marked, spool, table, text_hash, texts, unused

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Weak parts by role: they count only beside the other roles.
WEAK = {
    "id": re.compile(r"(?:user|username|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,})", re.IGNORECASE | re.ASCII),
    "pass": re.compile(r"(?:pass|pwd|passphrase|password|passwd|secret|token|api_?key|private_?key|credential)[\"']?\x20*[:=]\x20*[\"']?([^\s\"',;]{4,})", re.IGNORECASE | re.ASCII),
    "host": re.compile(r"(?:(?:host|server|endpoint|url|uri)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._:/-]{4,}|(?:https?|ftp|ssh|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@-]{3,})", re.IGNORECASE | re.ASCII),
}
#: The role that a base kind plays for its neighbours.
ROLE = {"assign": "pass", "access": "id", "hex": "pass"}
KINDS = [*LEAST, *WEAK]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base secrets, by start, then kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def weak_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, role) of weak parts, without what base spans cover of them; a piece counts if it holds a letter or digit of the part's value."""
    if "=" not in text and ":" not in text:
        return []
    whole: list[list[int]] = []  # base spans, those that touch as one
    for a, b, _ in base:
        if whole and a <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], b)
        else:
            whole.append([a, b])
    ends = [b for _, b in whole]
    found = []
    for role, pattern in WEAK.items():
        for m in pattern.finditer(text):
            value = m.start(1) if m.lastindex else m.start()
            at, k = m.start(), bisect_right(ends, m.start())
            while k < len(whole) and whole[k][0] < m.end():
                a, b = whole[k]
                k += 1
                if at < a and any(c.isalnum() for c in text[max(at, value) : a]):
                    found.append((at, a, role))
                at = b
            if at < m.end() and any(c.isalnum() for c in text[max(at, value) : m.end()]):
                found.append((at, m.end(), role))
    return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, row, t, base and weak: what single texts show. `row` tells rows apart that share a doc_id, `t` is the text's hash."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        let_go()
        for batch in batches:
            base, weak = [], []
            for text in batch.column("text").to_pylist():
                b = base_spans(text)
                base.append([dict(zip(("start", "stop", "kind"), s, strict=True)) for s in b])
                weak.append([dict(zip(("start", "stop", "kind"), s, strict=True)) for s in weak_spans(text, b)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "t")), pa.array(base, span), pa.array(weak, span)], names=["doc_id", "row", "t", "base", "weak"])

    kind = "array<struct<start:bigint,stop:bigint,kind:string>>"
    return texts(docs).select("*", F.monotonically_increasing_id().alias("row"), text_hash(F.col("text")).alias("t")).mapInArrow(run, f"doc_id long, row long, t long, base {kind}, weak {kind}")


def link_parts(found: DataFrame, *, scope: int, need: int) -> DataFrame:
    """row, linked: the weak parts with parts of at least `need` other roles no more than `scope` code points away, from end to start.

    Only documents with weak parts take part. Bins are `scope` wide, scopes twice that or more.
    """
    found = found.filter(F.size("weak") > 0)
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    weak = found.select("row", F.explode("weak").alias("s")).select("row", "s.start", "s.stop", F.col("s.kind").alias("role"))
    strong = found.select("row", F.explode("base").alias("s")).select("row", "s.start", "s.stop", role[F.col("s.kind")].alias("role"))
    bin_of: Callable[[Column], Column] = lambda c: F.floor(c / scope)
    lies_in = F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("stop") - 1)))
    parts = weak.unionByName(strong).withColumn("bin", lies_in).groupBy("row", "bin", "role").agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    around = weak.withColumn("bin", F.explode(F.sequence(bin_of(F.col("start") - scope), bin_of(F.col("stop") + scope))))
    near = (
        around.alias("w")
        .join(parts.alias("p"), (F.col("w.row") == F.col("p.row")) & (F.col("w.bin") == F.col("p.bin")) & (F.col("w.role") != F.col("p.role"))
              & (F.col("p.last") >= F.col("w.start") - scope) & (F.col("p.first") <= F.col("w.stop") + scope))
        .groupBy("w.row", "w.start", "w.stop", "w.role").agg(F.count_distinct("p.role").alias("others"))
    )
    return near.filter(F.col("others") >= need).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", F.concat(F.lit("weak_"), "role").alias("kind")))).alias("linked"))


def find_secrets(docs: DataFrame, *, scope: int = 400, need: int = 2) -> DataFrame:
    """doc_id, row, base, linked: base spans and linked weak spans of every document.

    `need`: complementary roles that a weak part must have within `scope` code points.
    """
    found = spool(scan(docs))
    linked = link_parts(found, scope=scope, need=need)
    return found.drop("weak").join(linked, "row", "left").withColumn("linked", F.coalesce("linked", F.expr("array()").cast(found.schema["base"].dataType)))


def redact(docs: DataFrame, *, scope: int = 400, need: int = 2, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span found replaced by `mark`; n_chars follows the text where there is such a column.

    Spans go to their rows by doc_id (null or not) and the text's hash, so rows
    that share a doc_id are cut each by its own text.
    """
    held = unused(docs, "spans")
    spans = find_secrets(docs, scope=scope, need=need).select("doc_id", "t", F.concat("base", "linked").alias(held)).filter(F.size(held) > 0).dropDuplicates(["doc_id", "t"])

    @F.pandas_udf("string")
    def cut(text, found):
        let_go()
        return type(text)([_cut(t, s, mark) for t, s in zip(text, found, strict=True)])

    out = marked(docs, spans, "left").withColumn("text", F.when(F.col(held).isNull(), F.col("text")).otherwise(cut("text", held)))
    out = out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
    return out.select(*docs.columns)


def _cut(text: str | None, found, mark: str) -> str | None:
    if text is None or found is None:
        return text
    out, at = [], 0
    for s in sorted(found, key=lambda s: (s["start"], -s["stop"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["stop"])
    return "".join([*out, text[at:]])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans, their hash, and all spans (base and linked) of every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    rank = F.create_map(*[F.lit(x) for i, k in enumerate([*LEAST, *(f"weak_{r}" for r in WEAK)]) for x in (k, i)])
    ordered = F.transform(
        F.array_sort(F.transform(F.concat("base", "linked"), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")),
    )
    return found.select("doc_id", *map(count, LEAST), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(ordered).alias("spans"))
