"""Content lists (a JSON array of blocks per document) to the block relation.

Absent fields and explicit nulls differ, so documents are read as VARIANT: an
absent array is NULL, a null one is empty. Single strings and nested lists become
flat arrays of non-blank strings. Lone surrogate escapes are dropped from the raw
text before it is parsed, as they would lose the whole value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.schema import BLOCK_FIELDS

#: An escaped surrogate that is not one half of a pair.
_PAIR = r"(\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})|\\u[dD][89a-fA-F][0-9a-fA-F]{2}"


def without_lone_surrogates(raw: Column) -> Column:
    return F.regexp_replace(raw, _PAIR, "$1")


#: Levels of lists in lists that are flattened.
DEPTH = 4


def _parts(v: Column, depth: int) -> Column:
    """A variant as an array of strings: lists in order, whatever they hold, and single values as they read."""
    one = F.array(F.try_variant_get(v, "$", "string"))
    if not depth:
        return one
    inner = F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _parts(x, depth - 1)))
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), inner).otherwise(one)


def _strings(v: Column, path: str) -> Column:
    """A field as an array of non-blank strings: NULL if absent, empty if null; nested lists are flattened."""
    got = F.try_variant_get(v, path, "variant")
    flat = F.filter(_parts(got, DEPTH), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    return F.when(got.isNull(), F.lit(None)).when(F.is_variant_null(got), F.array().cast("array<string>")).otherwise(flat)


def content_blocks(docs: DataFrame, *, body: str = "body") -> DataFrame:
    """Blocks of `docs` (doc_id and a JSON array of blocks); bodies that are not JSON give none."""
    items = docs.select("doc_id", F.try_parse_json(without_lone_surrogates(F.col(body))).alias("v"))
    rows = items.select("doc_id", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("block_seq", "b"))
    fields = {}
    for name, kind in BLOCK_FIELDS.items():
        fields[name] = _strings(F.col("b"), f"$.{name}") if kind == "array<string>" else F.try_variant_get("b", f"$.{name}", kind)
    return rows.select("doc_id", "block_seq", *[c.alias(n) for n, c in fields.items()])
