"""Text rules as column expressions. Blanks, digits and letters are Unicode's, and lengths count code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rules below, down to the characters per token, must be just so for a page to be cleaned alike.
#: Java's Unicode white space lacks the four separators U+001C..U+001F.
BLANK = r"[\s\x1C-\x1F]"
#: The same characters, one by one.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\R|[\x1C-\x1E]"
BULLET = rf"(?U)^{BLANK}*([•●▪–—\-*·]|\d+[.)]|[a-z][.)]){BLANK}"
FRAGMENT_CHARS = 32
NEAR_EMPTY_CHARS = 20
CHARS_PER_TOKEN = 4
#: Fixed values. A text that ends in one of these has finished its thought.
TOOL_FOLDERS = ("__MACOSX", "node_modules", "__pycache__")  # fixed values, beside all hidden ones
SENTENCE_END = ".!?:;。！？…\"')]}”’"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def is_blank(c: str | Column) -> Column:
    return F.length(strip(c)) == 0


def lines(c: str | Column) -> Column:
    """Lines of a text; a final line break opens no further line."""
    body = F.regexp_replace(col(c), rf"({LINE_BREAK})\z", "")
    return F.when(col(c) == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK))


def clean_page(c: str | Column) -> Column:
    """Join words hyphenated across lines, squeeze blanks, cut trailing ones, keep one empty line at most, strip; in this order."""
    t = F.regexp_replace(col(c), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?U)(\w)-[ \t]*\n[ \t]*(\w)", "$1$2")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"[ \t]+(?=\n|\z)", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def is_bullet(c: str | Column) -> Column:
    return col(c).rlike(BULLET)


def leaves_open(before: str | Column) -> Column:
    """Whether a text ends within a sentence."""
    a = strip(before)
    return (F.length(a) > 0) & ~F.substring(a, -1, 1).isin(*SENTENCE_END)


def carries_on(after: str | Column) -> Column:
    """Whether a text begins within a sentence."""
    b = strip(after)
    first = F.get(F.split(b, LINE_BREAK, 2), F.lit(0))
    return (F.length(b) > 0) & F.substring(b, 1, 1).rlike(r"^\p{IsLowercase}") & ~is_bullet(first)  # only then is a line looked for


def continues(before: str | Column, after: str | Column) -> Column:
    """Whether the text ``after`` carries on the sentence that ``before`` leaves open."""
    return leaves_open(before) & carries_on(after)


def preview(c: str | Column, width: int = 70) -> Column:
    """On one line, cut at ``width`` characters."""
    t = F.regexp_replace(strip(c), rf"(?U){BLANK}+", " ")
    return F.concat(F.substring(t, 1, width), F.when(F.length(t) > width, F.lit("...")).otherwise(F.lit("")))


def citation(source: str | Column, page: str | Column, page_end: str | Column) -> Column:
    s, p, e = col(source), col(page), col(page_end)
    span = e.isNotNull() & (e != 0) & (e != p)
    return F.when(span, F.concat(s, F.lit(" pp"), p.cast("string"), F.lit("-"), e.cast("string"))).otherwise(F.concat(s, F.lit(" p"), p.cast("string")))


def stem(source: str | Column) -> Column:
    """Folders and file name without its extension, joined by underscores."""
    s = col(source)
    bare = F.regexp_replace(s, r"(?<=[^/])\.[^./]+$", "")
    joined = F.regexp_replace(F.regexp_replace(bare, r"/+", "_"), r"^_+|_+$", "")
    return F.when(joined != "", joined).otherwise(F.regexp_replace(bare, r"^.*/", ""))


def chunk_id(source: str | Column, page: str | Column, index: str | Column) -> Column:
    return F.concat(stem(source), F.lit("_p"), col(page).cast("string"), F.lit("_c"), col(index).cast("string"))


def extension(path: str | Column) -> Column:
    """The lower-cased suffix with its dot; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]+)$", 1))


def is_skipped(path: str | Column) -> Column:
    """Whether any part of a relative path is hidden or names a folder of tools."""
    parts = F.split(col(path), "/")
    return F.exists(parts, lambda p: p.startswith(".") | p.isin(*TOOL_FOLDERS))


def token_estimate(chars: str | Column) -> Column:
    return F.floor(col(chars) / CHARS_PER_TOKEN)


def safe_name(name: str) -> str:
    """A name fit for a file: stripped, other characters replaced by underscores."""
    out = re.sub(r"[^A-Za-z0-9_.-]", "_", name.strip())
    if not out.strip("."):
        raise ValueError(f"not a usable name: {name!r}")
    return out


def extension_list(value: str) -> tuple[str, ...]:
    return tuple(x for x in (p.strip().lower() for p in value.split(",")) if x)
