"""Raw anchors whose href is empty, missing, a bare # or a script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelume.functions import text as t


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag: null if absent, empty without a value, entities decoded."""
    value = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))"""
    found = F.concat(*[F.regexp_extract(tag, value, k) for k in (1, 2, 3)])
    return F.when(tag.rlike(rf"(?i)\s{name}(\s|=|/|>|$)"), t.decode_entities(found))


# Characters that are shown of an anchor's text, place and HTML.
TEXT_CHARS, LOCATOR_CHARS, SNIPPET_CHARS = 80, 120, 200


def _line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every anchor of each page: url, pos, href (null if missing), text, locator, snippet."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a(?:\s[^>]*)?>.*?</a>"), F.lit(0))
    rows = pages.select("url", F.posexplode(found).alias("pos", "full"))
    tag = F.regexp_extract("full", r"(?is)^<a(?:\s[^>]*)?>", 0)
    ident, names = F.coalesce(attribute(tag, "id"), F.lit("")), F.coalesce(attribute(tag, "class"), F.lit(""))
    locator = F.concat_ws(
        " ",
        F.when(ident != "", F.concat(F.lit("#"), ident)),
        F.when(names != "", F.concat(F.lit("."), F.regexp_replace(F.trim(names), r"\s+", "."))),
    )
    return rows.select(
        "url",
        "pos",
        attribute(tag, "href").alias("href"),
        t.clip(_line(t.decode_entities(t.strip_tags(F.col("full")))), TEXT_CHARS).alias("text"),
        t.clip(F.when(locator == "", "(no id/class)").otherwise(locator), LOCATOR_CHARS).alias("locator"),
        t.clip(_line(F.col("full")), SNIPPET_CHARS).alias("snippet"),
    )


def classify(href: Column, with_hash: bool = True, with_script: bool = True) -> Column:
    value = F.regexp_replace(href, r"^\s+|\s+$", "")
    out = F.when(href.isNull(), "missing").when(value == "", "empty")
    if with_hash:
        out = out.when(value == "#", "hash")
    if with_script:
        out = out.when(value.rlike("(?i)^javascript:"), "javascript")
    return out


def findings(anchors_: DataFrame, **options: bool) -> DataFrame:
    return anchors_.withColumn("category", classify(F.col("href"), **options)).where("category IS NOT NULL")


def totals(findings_: DataFrame) -> DataFrame:
    """Findings of each page by category; defects are empty and missing ones."""
    kind = lambda c: F.count_if(F.col("category") == c).alias(c)
    return findings_.groupBy("url").agg(
        kind("empty"), kind("missing"), kind("hash"), kind("javascript"),
        F.count_if(F.col("category").isin("empty", "missing")).alias("defects"), F.count("*").alias("findings"),
    )


def worst_first(totals_: DataFrame, most: int | None = None) -> DataFrame:
    """Pages by defects, then findings; the first `most` of them with defects, if given."""
    order = [F.desc("defects"), F.desc("findings"), "url"]
    return totals_.orderBy(*order) if most is None else totals_.where("defects > 0").orderBy(*order).limit(most)
