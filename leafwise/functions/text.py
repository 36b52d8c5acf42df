"""Text helpers as Column expressions, and the one cleaning step that must run before text reaches the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LONE = re.compile("[\ud800-\udfff]")
#: White space as Python's str.strip() sees it.
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
_LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def clean_text(text: str | None) -> str:
    """Python side: drop surrogate code points, which UTF-8 (and so Spark) cannot hold."""
    return _LONE.sub("", text) if text else ""


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def lines(c: Column | str) -> Column:
    """Python's splitlines(), but for an empty last line."""
    return F.split(F.regexp_replace(c, f"(?:{_LINE_END})\\z", ""), _LINE_END)


def join_parts(parts: Column, by: str = "\n") -> Column:
    """Non-empty parts of an array, joined."""
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), by)


#: Wrappers that a vision model may put around its answer, in the order they are taken off.
THINK = r"(?is)^\s*<think>.*?</think>\s*"
BOILERPLATE = (
    r"(?i)^\s*(?:Here (?:is|are) (?:the |a )?(?:summary|analysis|key findings)|"
    r"以下是(?:图片|图像|该图|这张图片)?(?:的)?(?:分析|描述|摘要)|"
    r"根据(?:您提供的|提供的)?上下文(?:信息)?)[：:,，]\s*"
)
PREFIX = r"(?i)^\s*Image Description:\s*"
PAGE_MARK = r"(?i)\[Page\s+\d+\]"
CHUNK_MARK = r"(?i)\[ChunkType=[^\]]+\]"


def sanitize(c: Column | str, *, strict: bool = False) -> Column:
    """A model's answer without wrappers; every line stripped. Without `strict`, an unclosed think block raises."""
    out = strip(c)
    if not strict:
        out = F.regexp_replace(out, THINK, "")
        out = F.when(F.lower(out).startswith("<think>"), F.raise_error(F.lit("Incomplete vision reasoning block"))).otherwise(out)
        for pattern in (BOILERPLATE, PREFIX, PAGE_MARK, CHUNK_MARK):
            out = F.regexp_replace(out, pattern, "")
    return strip(F.array_join(F.transform(lines(out), strip), "\n"))


#: Headings whose section is left out.
DROPPED_HEADINGS = [
    r"acknowledgements?", r"acknowledgments?", r"author\s+contributions?", r"bibliography", r"conflict\s+of\s+interest",
    r"credit\s+authorship\s+contribution\s+statement", r"data\s+availability", r"declaration\s+of\s+competing\s+interest",
    r"declaration\s+of\s+interests?", r"declarations?", r"literature\s+cited", r"online",
    r"r\s+e\s+f\s+e\s+r\s+e\s+n\s+c\s+e\s+s", r"references?",
]
#: Numbering in front of a heading: Roman, Arabic or one word.
DROPPED = r"^\s*([ivxlcdm]+\.?|\d+\.?|\w+\.?)?\s*(" + "|".join(DROPPED_HEADINGS) + r")\s*[:.]?\s*$"


def is_dropped_heading(c: Column | str) -> Column:
    return F.coalesce(F.lower(strip(c)).rlike("(?iU)" + DROPPED), F.lit(False))


#: Page formats, and office formats that are converted first.
PAGE_FORMATS = ("pdf", "png", "jpeg", "jpg", "webp", "bmp", "tif", "tiff")
OFFICE_FORMATS = (
    "doc", "docx", "docm", "dot", "dotx", "ppt", "pptx", "pptm", "pps", "ppsx", "pot", "potx", "odp", "odt",
    "xls", "xlsx", "xlsm", "xlt", "xltx",
)


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\?#]+)(?:[?#].*)?$", 1))


def extension_list(exts: Column) -> Column:
    """Distinct extensions, dotted, sorted, joined by a comma."""
    fixed = F.transform(exts, lambda e: F.lower(F.trim(e)))
    dotted = F.transform(F.filter(fixed, lambda e: e != ""), lambda e: F.when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e)))
    return F.array_join(F.array_sort(F.array_distinct(dotted)), ", ")


def chosen_formats(wanted: Column | str) -> Column:
    """The dotted formats of a comma-separated list, each once and sorted; `all`: every supported one. One that is not supported raises with the names of those that are not."""
    allowed = F.array(*[F.lit(f".{f}") for f in sorted({*PAGE_FORMATS, *OFFICE_FORMATS})])
    named = F.transform(F.split(wanted, ","), lambda e: F.concat(F.lit("."), F.regexp_replace(F.lower(F.trim(e)), r"^\.+", "")))
    unknown = F.array_sort(F.array_except(named, allowed))
    error = F.raise_error(F.concat(F.lit("Unsupported extensions: "), F.array_join(unknown, ", "))).cast("array<string>")
    given = F.when(F.size(unknown) > 0, error).otherwise(F.array_sort(F.array_union(named, F.array().cast("array<string>"))))
    return F.when(F.lower(F.trim(wanted)) == "all", allowed).otherwise(given)


def tier(backend: Column | str) -> Column:
    """Parse tier for a tier name or an older backend name."""
    name = F.lower(F.trim(backend))
    return F.when(name.isin("flash", "basic", "standard", "advanced"), name).when(name == "pipeline", "basic").when(name.startswith("vlm-") | (F.coalesce(name, F.lit("")) == ""), "advanced").otherwise("standard")


def url_list(c: Column | str) -> Column:
    """Array of addresses from a JSON array or a comma-separated string."""
    given = F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, ","))
    return F.filter(F.transform(given, lambda u: F.trim(u)), lambda u: u != "")


def member_name(c: Column | str) -> Column:
    """Upper-case identifier: other characters become one underscore."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z]+", "_"), r"^_+|_+$", ""))


def safe_filename(c: Column | str, suffix: str) -> Column:
    """Last path part, with `suffix`."""
    name = F.regexp_extract(F.regexp_replace(c, r"\\", "/"), r"([^/]*)$", 1)
    name = F.when(name == "", "document").otherwise(name)
    return F.when(F.lower(name).endswith(suffix), name).otherwise(F.concat(name, F.lit(suffix)))


#: The named character references that forms hold.
REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "copy": "©", "nbsp": "\u00a0", "ensp": "\u2002", "emsp": "\u2003", "thinsp": "\u2009", "ndash": "–", "mdash": "—", "middot": "·", "hellip": "…", "times": "×", "deg": "°", "plusmn": "±"}


def named(c: Column | str) -> Column:
    """The character references above as characters; an ampersand last."""
    c = c if isinstance(c, Column) else F.col(c)
    for name, char in REFERENCES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def unescape(c: Column | str) -> Column:
    """Character references as characters: numbers of either base, and the names above."""
    c = c if isinstance(c, Column) else F.col(c)
    number = lambda x: F.when(F.lower(F.substring(x, 3, 1)) == "x", F.conv(F.regexp_extract(x, "(?i)^&#x([0-9a-f]+);$", 1), 16, 10)).otherwise(F.regexp_extract(x, "^&#([0-9]+);$", 1)).cast("long")
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    fine = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    parts = F.split(F.regexp_replace(c, r"(?i)(&#(?:[0-9]{1,7}|x[0-9a-f]{1,6});)", "\x01$1\x01"), "\x01")
    shown = F.transform(parts, lambda x: F.when(x.startswith("&#") & fine(number(x)), letter(number(x))).otherwise(x))
    return named(F.when(c.contains("&#"), F.array_join(shown, "")).otherwise(c))


def label(c: Column | str) -> Column:
    """A checkbox label in normal form: no references, tags, white space or closing punctuation."""
    bare = F.regexp_replace(F.regexp_replace(unescape(c), r"<[^>]+>", ""), r"(?U)\s+", "")
    return F.regexp_replace(bare, r"^[ :：;；,，]+|[ :：;；,，]+$", "")


def labels_match(a: Column, b: Column) -> Column:
    """Normal labels that are equal, or one of four letters or more that begins the other."""
    return (a != "") & (b != "") & ((a == b) | ((F.length(a) >= 4) & b.startswith(a)) | ((F.length(b) >= 4) & a.startswith(b)))
