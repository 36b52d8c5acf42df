"""Names that follow from content: canonical JSON, name-based ids, address keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(c: Column) -> Column:
    """A string as JSON, with its quotes; NULL as null."""
    text = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def canonical_json(values: Column) -> Column:
    """A map from names to JSON values as one JSON object: sorted names, a space behind colons and commas."""
    parts = F.transform(F.array_sort(F.map_entries(values)), lambda e: F.concat(json_string(e["key"]), F.lit(": "), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def name_id(namespace: str, name: Column) -> Column:
    """The version-5 UUID of a name: SHA-1 of the namespace's bytes and the name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def job_id(namespace: str, mode: Column, key: Column) -> Column:
    return name_id(namespace, F.concat(mode, F.char(F.lit(0)), key))


def endpoint_key(url: Column) -> Column:
    """Equal for addresses that differ in the case of scheme and host, a default port or a final slash: the hash of the address in one form."""
    low = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(low, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.regexp_replace(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), r"/+$", "")
    return F.sha2(F.concat(host, rest), 256)
