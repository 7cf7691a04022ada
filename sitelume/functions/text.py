"""Text expressions: pixel widths, HTML fragments, redaction, lenient numbers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Estimated widths of characters in pixels, and of any other character.
CHAR_PIXELS = {
    "a": 9, "b": 9, "c": 8, "d": 9, "e": 9, "f": 5, "g": 9, "h": 9, "i": 4, "j": 4, "k": 8, "l": 4, "m": 14,
    "n": 9, "o": 9, "p": 9, "q": 9, "r": 6, "s": 8, "t": 5, "u": 9, "v": 8, "w": 12, "x": 8, "y": 8, "z": 8,
    "A": 12, "B": 12, "C": 13, "D": 13, "E": 12, "F": 11, "G": 14, "H": 13, "I": 5, "J": 5, "K": 12, "L": 10,
    "M": 15, "N": 13, "O": 14, "P": 12, "Q": 14, "R": 13, "S": 12, "T": 11, "U": 13, "V": 12, "W": 17, "X": 12,
    "Y": 12, "Z": 11, "0": 9, "1": 9, "2": 9, "3": 9, "4": 9, "5": 9, "6": 9, "7": 9, "8": 9, "9": 9, " ": 5,
    ".": 5, ",": 5, "-": 6, "_": 8, ":": 5, ";": 5, "!": 5, "?": 9, "'": 3, '"': 6, "(": 6, ")": 6, "/": 5,
    "&": 12, "|": 4,
}
OTHER_PIXELS = 8
TITLE_PIXELS, DESCRIPTION_PIXELS = 579, 919


def pixel_width(text: Column) -> Column:
    """Estimated width of a text in a search result, in pixels; null for null.

    Characters of one width are counted together by length differences, so the
    estimate is a sum of a few built-in string functions.
    """
    by_width: dict[int, str] = {}
    for char, width in CHAR_PIXELS.items():
        by_width[width] = by_width.get(width, "") + char
    total = F.length(text) * OTHER_PIXELS
    for width, chars in sorted(by_width.items()):
        if width != OTHER_PIXELS:
            others = F.length(F.translate(text, chars, ""))
            total = total + (F.length(text) - others) * (width - OTHER_PIXELS)
    return total.cast("bigint")


def js_length(text: Column) -> Column:
    """Length in UTF-16 units, as browsers count."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.regexp_replace(text, r"\s+", "") == "", F.lit(True))


def or_none(text: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(text, F.lit(""))


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


# Entities in the order they are decoded.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;|&apos;", "'"), ("&nbsp;", " "))


def decode_entities(text: Column) -> Column:
    for pattern, char in ENTITIES:
        text = F.regexp_replace(text, pattern, char)
    return text


def body_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags go, white space collapses."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)", 1)
    body = F.regexp_replace(body, r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"\s+", " "))


def word_count(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, " "))).cast("bigint")


# What counts as a mail address or a phone number.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+\d{1,3}[\s-]?)?\(?\d{2,4}\)?[\s-]?\d{3,4}[\s-]?\d{3,4}|\b\d{3}[\s-]\d{4}\b"


def redact(text: Column) -> Column:
    """Emails, then phone numbers, replaced by markers."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[REDACTED_EMAIL]"), PHONE, "[REDACTED_PHONE]")


def int_prefix(text: Column) -> Column:
    """The integer a text begins with, else null."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0).otherwise(F.floor(part * 100 / whole + 0.5)).cast("bigint")


def is_email(text: Column) -> Column:
    return text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def hide_credentials(text: Column) -> Column:
    return F.regexp_replace(text, r"(//)[^/@\s]*@", "$1")


def markdown_escape(url: Column) -> Column:
    """A URL as Markdown text: signs of links, tables and code are escaped, line ends become spaces."""
    return F.regexp_replace(F.regexp_replace(url, r"([\\`*_\[\]()|])", r"\\$1"), r"[\r\n]", " ")


def markdown_link(url: Column) -> Column:
    """A Markdown link, for http(s) URLs only."""
    safe = markdown_escape(url)
    return F.when(url.rlike("(?i)^https?://"), F.concat(F.lit("["), safe, F.lit("]("), safe, F.lit(")"))).otherwise(safe)


@F.pandas_udf(T.StringType())
def _folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def slug(heading: Column) -> Column:
    """A heading as an anchor: accents off, lower case, letters and digits joined by hyphens."""
    plain = F.lower(F.when(heading.rlike(r"[^\x00-\x7f]"), _folded(heading)).otherwise(heading))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
