"""Issue rows of single pages and of duplicate values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelume.functions import text as t
from sitelume.functions import urls

from .groups import join_groups

# Lengths that a title, description or H1 should keep to.
TITLE_CHARS, DESCRIPTION_CHARS, H1_CHARS = (30, 60), (70, 160), (10, 70)
#: Headings up to this level and so many characters of the text go into a request for a fix.
FIX_LEVEL, EXCERPT_CHARS = 2, 1500


def is_html(content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (F.trim(kind) == "") | kind.contains("text/html") | kind.contains("application/xhtml")


def is_pdf(url: Column, content_type: Column) -> Column:
    return F.lower(url).endswith(".pdf") | F.lower(F.coalesce(content_type, F.lit(""))).contains("application/pdf")


def html_pages(pages: DataFrame) -> DataFrame:
    """Pages that reports look at: HTML by their content type (or without one)."""
    return pages.where(is_html(F.col("content_type")))


def audit_pages(pages: DataFrame) -> DataFrame:
    """Pages that the audit looks at: HTML, and no PDF by its name."""
    return html_pages(pages).where(~is_pdf(F.col("url"), F.col("content_type")))


def pdf_pages(pages: DataFrame) -> DataFrame:
    """The PDF files of a crawl, which the audit lists by themselves."""
    return pages.where(is_pdf(F.col("url"), F.col("content_type")))


def length_issues(value: Column, chars: tuple[int, int], pixels: int | None) -> Column:
    """missing, too_short, too_long and pixel_too_long of a value, as an array."""
    n = t.js_length(value)
    rules = [F.when(n < chars[0], "too_short").when(n > chars[1], "too_long")]
    if pixels is not None:
        rules.append(F.when(t.pixel_width(value) > pixels, "pixel_too_long"))
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return F.when(t.is_blank(value), F.array(F.lit("missing"))).otherwise(found)


def repeated(pages: DataFrame, column: str, others_of: str = "url") -> DataFrame:
    """Rows whose value (blank ones aside) another row has too: value, url, pages (rows of the value)."""
    full = pages.where(~t.is_blank(F.col(column))).select(F.col(column).alias("value"), others_of)
    groups = full.groupBy("value").agg(F.count("*").alias("pages")).where("pages > 1")
    return join_groups(full, groups, "value")


def duplicates(pages: DataFrame, column: str) -> DataFrame:
    """A row for each page whose value another page has too: value, url."""
    return repeated(pages, column).select("value", "url")


def value_issues(pages: DataFrame, column: str, chars: tuple[int, int], pixels: int) -> DataFrame:
    """A row for each page and issue of `column`; duplicates with the number of other pages that share the value.

    `duplicates` gives the pages themselves. Blank values never meet in a join.
    """
    value = F.col(column)
    told = pages.select("url", column, F.when(~t.is_blank(value), value).alias("value"))
    groups = told.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("pages")).where("pages > 1")
    told = join_groups(told, groups, "value", "left")
    found = F.concat(length_issues(value, chars, pixels), F.when(F.col("pages") > 1, F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>")))
    return told.select("url", column, "pages", F.explode(found).alias("issue")).select(
        "url", "issue", t.js_length(value).alias("chars"), t.pixel_width(value).alias("pixels"), F.when(F.col("issue") == "duplicate", F.col("pages") - 1).alias("others")
    )


def h1_issues(pages: DataFrame, column: str = "h1s") -> DataFrame:
    """A row for each page and issue of its first-level headings (`column`, an array of texts).

    missing and multiple are of the page (h1 null), too_short, too_long and
    duplicate of one heading, others being its occurrences on other pages.
    """
    headings = F.coalesce(column, F.array().cast("array<string>"))
    n = F.size(headings)
    of_page = F.filter(F.array(F.when(n == 0, "missing"), F.when(n > 1, "multiple")), lambda x: x.isNotNull())
    page = pages.select("url", F.lit(None).cast("string").alias("h1"), F.explode(of_page).alias("issue"), F.lit(None).cast("bigint").alias("others"))
    rows = pages.select("url", F.posexplode(headings).alias("pos", "h1"))
    length = t.js_length(F.col("h1"))
    short_or_long = F.when(length < H1_CHARS[0], "too_short").when(length > H1_CHARS[1], "too_long")
    size = rows.select("url", "h1", short_or_long.alias("issue"), F.lit(None).cast("bigint").alias("others")).where("issue IS NOT NULL")
    groups = rows.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1")
    on_page = rows.groupBy("url", "h1").agg(F.count("*").alias("own"))
    same = join_groups(on_page, groups, "h1").select(
        "url", "h1", F.explode(F.array_repeat(F.lit("duplicate"), F.col("own").cast("int"))).alias("issue"), (F.col("n") - F.col("own")).alias("others")
    )
    return page.unionByName(size).unionByName(same)


def peers(pages: DataFrame, column: str) -> DataFrame:
    """Values that pages share: the group's size, its first and its last URL. `duplicates` gives all members."""
    groups = pages.where(~t.is_blank(F.col(column))).groupBy(column)
    groups = groups.agg(F.count("*").alias("pages"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))
    return groups.where("pages > 1").select(F.col(column).alias("value"), "pages", "first_url", "last_url")


OPEN_GRAPH = ("og_title", "og_description", "og_image", "og_url")


def open_graph(pages: DataFrame) -> DataFrame:
    """Pages with some but not all of the four Open Graph values, and which are missing."""
    missing = F.filter(
        F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in OPEN_GRAPH]), lambda x: x.isNotNull()
    )
    told = pages.select("url", missing.alias("gone"))
    some = (F.size("gone") > 0) & (F.size("gone") < len(OPEN_GRAPH))
    return told.where(some).select("url", F.array_join("gone", ",").alias("missing"))


def twitter_card_missing(pages: DataFrame) -> DataFrame:
    return pages.where(F.coalesce("twitter_card", F.lit("")) == "").select("url")


def redirects(pages: DataFrame) -> DataFrame:
    """3xx pages; those that only move to https on the same host are upgrades."""
    moved = pages.where("status >= 300 AND status < 400")
    upgrade = (
        F.col("url").startswith("http://")
        & F.col("final_url").startswith("https://")
        & (urls.host(F.col("url")) == urls.host(F.col("final_url")))
    )
    return moved.select("url", "status", "final_url", F.when(upgrade, "https_upgrade").otherwise("other").alias("kind"))


def response_class(status: Column) -> Column:
    """How a response is treated: blocked, not_found, login_redirect or error (extraction is limited), else complete."""
    return (
        F.when(status == 403, "blocked")
        .when(status == 404, "not_found")
        .when(status == 302, "login_redirect")
        .when(status >= 400, "error")
        .otherwise("complete")
    )


def language(url: Column, declared: Column) -> Column:
    """cs or en: by the declared language, else by a path that begins with /cs/ or a URL that ends with it."""
    lang = F.lower(F.coalesce(declared, F.lit("")))
    czech = (urls.path(url).startswith("/cs/") | url.endswith("/cs/")) & urls.is_absolute(url)
    return F.when(lang.startswith("cs"), "cs").when(lang.startswith("en"), "en").when(czech, "cs").otherwise("en")


def fix_candidates(pages: DataFrame) -> DataFrame:
    """Pages whose title or description needs a fix: language and the issues of each."""
    told = pages.select(
        "url",
        language(F.col("url"), F.col("lang")).alias("language"),
        length_issues(F.col("title"), TITLE_CHARS, t.TITLE_PIXELS).alias("t"),
        length_issues(F.col("description"), DESCRIPTION_CHARS, t.DESCRIPTION_PIXELS).alias("d"),
    )
    return told.where((F.size("t") > 0) | (F.size("d") > 0)).select(
        "url", "language", F.array_join("t", ",").alias("title_issues"), F.array_join("d", ",").alias("description_issues")
    )


def fix_context(headings: Column, full_text: Column) -> tuple[Column, Column]:
    """What a request for a fix tells of a page: headings of the first levels (array), and the text's beginning."""
    high = F.transform(F.filter(headings, lambda h: h["level"] <= FIX_LEVEL), lambda h: h["text"])
    return high, F.substring(F.coalesce(full_text, F.lit("")), 1, EXCERPT_CHARS)
