"""Text expressions that corpus operators share.  White-space classes are spelt out, so that they mean the same everywhere."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\x{00A0}\x{3000}]"
#: Zero-width and direction marks, control characters, and circled numbers, which keep their form (fixed values).
ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
CIRCLED = "".join(chr(c) for a, b in ((0x2460, 0x2473), (0x24EA, 0x24EA), (0x24F5, 0x24FF), (0x2776, 0x2793), (0x3251, 0x325F), (0x32B1, 0x32BF)) for c in range(a, b + 1))
_KEEP = {ord(c): None for c in CIRCLED}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def nfkc(c: Column, circled: bool = False) -> Column:
    """NFKC (Spark has no such function); circled numbers stay as they are unless asked for."""
    keep = {} if circled else _KEEP

    def one(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t
        if any(ord(x) in keep for x in t):
            return "".join(x if ord(x) in keep else unicodedata.normalize("NFKC", x) for x in t)
        return unicodedata.normalize("NFKC", t)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return F.pandas_udf(run, T.StringType())(c)


def normalize_text(c: Column) -> Column:
    """No zero-width characters, control characters as spaces, NFKC, \\n line ends, single blanks, at most one blank line."""
    c = nfkc(F.regexp_replace(F.regexp_replace(c, ZERO_WIDTH, ""), CONTROL, " "))
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def source_text(c: Column) -> Column:
    """A text with \\n line ends, single blanks, at most one blank line, and nothing around it."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\x{FEFF}", ""), r"\r\n?", "\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def markdown_to_text(c: Column) -> Column:
    """Text without code blocks, images, link targets, table bars, and the marks that lines begin with."""
    c = F.regexp_replace(c, r"(?s)```.*?```", "")
    c = F.regexp_replace(F.regexp_replace(c, r"!\[[^\]]*\]\([^)]+\)", " "), r"\[([^\]]+)\]\([^)]+\)", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)^[>#\-*\s|]+", ""), r"\|", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


#: Images of parsed pages: in Markdown, in HTML, and their bare paths (fixed values).
IMAGES = (r"!\[[^\]]*\]\((?:data:[^)]*|imgs/[^)\s]+)\)", r"(?i)<img[^>]*?src=[\"'](?:data:[^\"']+|imgs/[^\"']+)[\"'][^>]*>", r"\bimgs/[^\s)\"']+")


def strip_images(c: Column) -> Column:
    """Text without the images of parsed pages."""
    for pattern in IMAGES:
        c = F.regexp_replace(c, pattern, "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def strip_tables(c: Column, tables: Column) -> Column:
    """Text without the markup of tables (array of structs html, markdown) that are stored by themselves."""
    wrapped = lambda h: F.concat(F.lit('<div style="text-align: center;">'), h, F.lit("</div>"))
    drop = lambda text, part: F.when(F.coalesce(strip(part), F.lit("")) == "", text).otherwise(F.replace(F.replace(text, strip(part), F.lit("")), wrapped(F.lit("")), F.lit("")))
    bare = F.aggregate(F.coalesce(tables, F.array().cast("array<struct<html:string,markdown:string>>")), c, lambda text, t: drop(drop(text, t["html"]), t["markdown"]))
    return strip(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def token_estimate(c: Column) -> Column:
    """CJK characters, and a quarter of the others, rounded up."""
    cjk = F.regexp_count(c, F.lit(r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]")).cast("long")
    return F.coalesce(cjk + F.ceil((F.length(c) - cjk) / 4), F.lit(0)).cast("long")
