"""Parsed documents as a Spark data source: `spark.read.format("leafwise_blocks")`.

It reads three kinds of files under its paths:

* `*.jsonl`: a page of a document in each line, `{"doc_id": .., "tier": .., "page_idx": .., "blocks": [..]}`,
  as `write_pages` writes them; a file is cut into slices of bytes, a partition for each;
* `*.json`: a content list, the blocks of one document in one array, named by the file's stem;
* `*.xml`: a document's pages with positional words, each of which is a block of type `word`.

Conditions on doc_id, tier and page_idx are taken over by the scan. Files and
lines that they rule out are passed over by their names and by the head of the
line, page elements by their number: they are never parsed.

Spark 4.1 keeps what a Python source has taken over with the loaded source, for
all plans that use it: of two plans with different conditions on one loaded
DataFrame, both get the conditions planned last. `read_blocks` is safe from that,
as it loads anew for each call and lets nothing but its own `where` be taken
over. Who calls `spark.read.format` must load once for each set of conditions.

Options: `path` or `paths` (a JSON list); `keep`: `last` (of several paths the
last one's result is what counts) or `all` (all of them; a name that several
paths hold comes from the last); `tier` of files that name none; `sliceBytes`.
Files are opened where the path says, on any store that Arrow can open.
"""

from __future__ import annotations

import html
import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from leafwise.functions.text import clean_text
from leafwise.schema import BLOCK_FIELDS

NAME = "leafwise_blocks"
_TYPES = {"string": StringType(), "int": IntegerType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType()), "array<double>": ArrayType(DoubleType())}
SCHEMA = StructType([StructField(n, _TYPES[k]) for n, k in {"doc_id": "string", "tier": "string", "block_seq": "int", **BLOCK_FIELDS}.items()])
SLICE_BYTES = 64 << 20
BATCH_ROWS = 4096
PUSHED = {"doc_id", "tier", "page_idx"}
#: The head of a line of write_pages: what decides whether the rest is parsed.
HEAD = re.compile(rb'\{"doc_id":("(?:[^"\\]|\\.)*"),(?:"tier":("(?:[^"\\]|\\.)*"|null),)?"page_idx":(-?\d+),')
PAGE = re.compile(r"<(?:\w+:)?page\b[^>]*?(?:/>|>(.*?)</(?:\w+:)?page>)", re.DOTALL)
WORD = re.compile(r"<(?:\w+:)?word\b([^>]*)>(.*?)</(?:\w+:)?word>", re.DOTALL)
ATTRIBUTE = re.compile(r"(\w+)\s*=\s*\"([^\"]*)\"")


def _holds(f: Filter, value: Any) -> bool:
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, GreaterThan):
        return value > f.value
    if isinstance(f, GreaterThanOrEqual):
        return value >= f.value
    return value < f.value if isinstance(f, LessThan) else value <= f.value


@dataclass
class Wanted:
    """The conditions that a scan has taken over, by column."""

    filters: list[Filter] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Take a condition over if it is one on a pushed column."""
        known = isinstance(f, (EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual))
        if known and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
            self.filters.append(f)
            return True
        return False

    def allows(self, column: str, value: Any) -> bool:
        return all(_holds(f, value) for f in self.filters if f.attribute[0] == column)


@dataclass
class Slice(InputPartition):
    path: str
    start: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """URI or path, and size, of the files under `path` that are read, by name."""
    store, at = opened(path)
    found = store.get_file_info(at)
    infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    names = [(i.path, i.size) for i in infos if i.type == fs.FileType.File and i.extension.lower() in ("json", "jsonl", "xml", "txt") and not i.base_name.startswith(("_", "."))]
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    if not names:
        raise FileNotFoundError(f"no parsed documents under {path}")
    return sorted((head + p, n) for p, n in names)


def stem(path: str) -> str:
    return re.sub(r"(_content_list)?\.\w+$", "", path.rsplit("/", 1)[-1])


def strings(value: Any) -> list[str]:
    """A field as a flat list of non-blank strings."""
    if isinstance(value, list):
        return [s for v in value for s in strings(v)]
    if value is None:
        return []
    text = clean_text(value if isinstance(value, str) else str(value))
    return [text] if text.strip() else []


def _number(kind: type) -> Callable[[Any], Any]:
    def read(value: Any) -> Any:
        try:
            return None if value is None or isinstance(value, bool) else kind(value)
        except (TypeError, ValueError):
            return None

    return read


_READ: dict[str, Callable[[Any], Any]] = {
    "string": lambda v: None if v is None else clean_text(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)),
    "int": _number(int),
    "boolean": lambda v: v if isinstance(v, bool) else None,
    "array<double>": lambda v: [_number(float)(x) for x in v] if isinstance(v, list) else None,
    "array<string>": strings,
}


def block_row(doc_id: str, tier: str | None, seq: int, block: dict[str, Any], page: int | None) -> dict[str, Any]:
    """A block as a row: absent fields are None, null arrays are present and empty."""
    row: dict[str, Any] = {n: _READ[k](block[n]) for n, k in BLOCK_FIELDS.items() if n in block}
    if "page_idx" not in block and page is not None:
        row["page_idx"] = page
    return row | {"doc_id": doc_id, "tier": tier, "block_seq": seq}


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.wanted = Wanted()
        self.tier = options.get("tier")
        self.size = int(options.get("sliceBytes", SLICE_BYTES))
        paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.paths = paths if options.get("keep", "last") == "all" else paths[-1:]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Slice]:
        last = {p.rsplit("/", 1)[-1]: (p, n) for path in self.paths for p, n in listed(path)}
        out = []
        for path, size in last.values():
            if not path.endswith((".jsonl", ".txt")):
                if self.wanted.allows("doc_id", stem(path)) and self.wanted.allows("tier", self.tier):
                    out.append(Slice(path, 0, size))
                continue
            out += [Slice(path, at, min(at + self.size, size)) for at in range(0, size, self.size)]
        return out or [Slice("", 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        kinds, held = to_arrow_schema(SCHEMA), []
        for row in self.rows(part) if part.path else ():
            held.append(row)
            if len(held) == BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held = []
        yield pa.RecordBatch.from_pylist(held, kinds)

    def rows(self, part: Slice) -> Iterator[dict[str, Any]]:
        store, at = opened(part.path)
        with store.open_input_file(at) as file:
            if part.path.endswith((".jsonl", ".txt")):
                yield from self.page_lines(io.BufferedReader(file, 1 << 20), part)
            elif part.path.endswith(".xml"):
                yield from self.page_words(file.read().decode(), stem(part.path))
            else:
                yield from self.content_list(file.read().decode(), part.path)

    def page_lines(self, file: io.BufferedReader, part: Slice) -> Iterator[dict[str, Any]]:
        """The blocks of the lines that begin within the slice."""
        wanted, at = self.wanted, part.start
        if at:
            file.seek(at - 1)
            at += len(file.readline()) - 1
        while at < part.end and (line := file.readline()):
            at += len(line)
            head = HEAD.match(line)
            if head:
                doc, tier = json.loads(head[1]), json.loads(head[2] or b"null") or self.tier
                if not (wanted.allows("page_idx", int(head[3])) and wanted.allows("doc_id", doc) and wanted.allows("tier", tier)):
                    continue
            if not line.strip():
                continue
            try:
                page = json.loads(line)
            except ValueError as e:
                raise ValueError(f"{part.path}: no JSON at byte {at - len(line)}: {e}") from None
            doc, tier, number = str(page["doc_id"]), page.get("tier") or self.tier, page.get("page_idx")
            if wanted.allows("page_idx", number) and wanted.allows("doc_id", doc) and wanted.allows("tier", tier):
                for i, block in enumerate(page["blocks"]):
                    yield block_row(doc, tier, block.get("block_seq", i), block, number) | {"page_idx": number}

    def content_list(self, text: str, path: str) -> Iterator[dict[str, Any]]:
        for seq, block in enumerate(json.loads(text)):
            if self.wanted.allows("page_idx", _number(int)(block.get("page_idx"))):
                yield block_row(stem(path), self.tier, seq, block, None)

    def page_words(self, text: str, doc: str) -> Iterator[dict[str, Any]]:
        seq = 0
        for number, page in enumerate(PAGE.finditer(text)):
            if not self.wanted.allows("page_idx", number):
                seq += (page[1] or "").count("<word") if page[1] else 0
                continue
            for word in WORD.finditer(page[1] or ""):
                own = dict(ATTRIBUTE.findall(word[1]))
                box = [float(own[k]) for k in ("xMin", "yMin", "xMax", "yMax") if k in own]
                yield {"doc_id": doc, "tier": self.tier, "block_seq": seq, "page_idx": number, "type": "word", "text": clean_text(html.unescape(word[2]).strip()), "bbox": box}
                seq += 1


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BlockReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with its conditions pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockSource)


def read_blocks(spark: SparkSession, *paths: str, where: Column | str | None = None, **options: str) -> DataFrame:
    """The blocks of parsed documents under `paths`, of which no more is parsed than `where` (on doc_id, tier, page_idx) asks for; it may hold other conditions too."""
    register(spark)
    loaded = spark.read.format(NAME).options(paths=json.dumps(paths), **options).load()
    # A sample of all rows: conditions from above stay above it (see the module's text).
    return (loaded if where is None else loaded.filter(where)).sample(1.0)


def write_pages(blocks: DataFrame, path: str) -> None:
    """One line for each page of each document, its blocks in order; `blocks`: doc_id, page_idx, block_seq and block fields, and tier if there is one."""
    fields = [c for c in blocks.columns if c in BLOCK_FIELDS and c != "page_idx"]
    tier = F.col("tier").cast("string") if "tier" in blocks.columns else F.lit(None).cast("string")
    lines = blocks.select(F.col("doc_id").cast("string"), tier.alias("tier"), F.coalesce("page_idx", F.lit(0)).alias("page_idx"), F.struct("block_seq", *fields).alias("b"))
    pages = lines.groupBy("doc_id", "tier", "page_idx").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    pages.select(F.to_json(F.struct("doc_id", "tier", "page_idx", "blocks")).alias("value")).write.text(path)
