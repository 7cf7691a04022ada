"""Stable identifiers: the first 16 hex digits of SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import js_length

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _short(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def url_id(url: Column, stamp: Column) -> Column:
    return _short(F.concat(url, F.lit("::"), stamp))


def response_id(url: Column, status: Column, stamp: Column, content_type: Column, modified: Column, etag: Column) -> Column:
    """Over the JSON of what identifies a response; headers that are missing are null in it."""
    text = lambda c: c.cast("string")
    headers = F.struct(text(content_type).alias("content-type"), text(modified).alias("last-modified"), text(etag).alias("etag"))
    known = F.struct(url.alias("url"), status.alias("status"), stamp.alias("timestamp"), headers.alias("headers"))
    return _short(F.to_json(known, _KEEP_NULLS))


def content_id(content: Column, stamp: Column) -> Column:
    """Over the JSON of the trimmed text and the length of the whole, in UTF-16 units."""
    text = F.regexp_replace(content, r"(?U)^\s+|\s+$", "")
    known = F.struct(text.alias("content"), stamp.alias("timestamp"), js_length(content).alias("contentLength"))
    return _short(F.to_json(known, _KEEP_NULLS))
