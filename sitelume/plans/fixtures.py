"""Crawl tables derived from `pages`, in the same way for Spark and for the oracle.

The test pages carry HTML but no crawl facts, so status, meta values and links
are expressions over page_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelume.functions import text as t


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SAME = "The same words on many pages, of a length that is no issue by itself, only by being repeated."
_URL = """CASE page_id % 20 WHEN 3 THEN concat('https://www.site', page_id % 7, '.example/kontakt/', page_id)
    WHEN 5 THEN concat('https://site', page_id % 7, '.example/cs/', page_id) WHEN 7 THEN concat('https://site', page_id % 7, '.example/Sluzby/', page_id)
    WHEN 9 THEN concat('https://site', page_id % 7, '.example/o-nas/', page_id) WHEN 11 THEN concat('https://site', page_id % 7, '.example/faq/', page_id)
    WHEN 13 THEN concat('https://site', page_id % 7, '.example/2024/05/', page_id) WHEN 15 THEN concat('https://home', page_id, '.example/')
    WHEN 17 THEN concat('https://site', page_id % 7, '.example/a/cs/b', page_id) WHEN 19 THEN concat('https://site', page_id % 7, '.example/doc', page_id, '.PDF')
    ELSE url END"""
_FACTS = """page_id, url, html,
  CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 301 WHEN page_id % 29 = 0 THEN 500 ELSE 200 END AS status,
  CASE WHEN page_id % 2 = 0 THEN replace(url, 'http://', 'https://') ELSE concat(url, '/moved') END AS final_url,
  CASE WHEN page_id % 19 = 0 THEN 'application/PDF' WHEN page_id % 31 = 0 THEN ' ' WHEN page_id % 37 = 0 THEN 'application/rss+xml'
    WHEN page_id % 23 <> 0 THEN 'Text/HTML; charset=utf-8' END AS content_type,
  CASE WHEN page_id % 11 = 0 THEN 'noindex, follow' END AS robots,
  CASE WHEN page_id % 6 <> 0 THEN url END AS canonical,
  CASE WHEN page_id % 2 = 0 THEN 'og' END AS og_title,
  CASE WHEN page_id % 3 = 0 THEN 'og' ELSE '' END AS og_description,
  CASE WHEN page_id % 5 <> 0 THEN 'og' END AS og_image,
  CASE WHEN page_id % 7 <> 0 THEN 'og' END AS og_url,
  CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN '' ELSE 'summary' END AS twitter_card,
  CASE WHEN page_id % 9 = 0 THEN 'x-default' WHEN page_id % 9 < 4 THEN 'en' END AS hreflang,
  CASE WHEN page_id % 8 = 0 THEN 'cs-CZ' WHEN page_id % 8 = 1 THEN 'EN' END AS lang,
  CASE page_id % 8 WHEN 1 THEN '{"@type":"Article"}' WHEN 2 THEN '{"@graph":[{"@type":"WebPage"},{"@type":"BreadcrumbList"}]}'
    WHEN 3 THEN '{"@type":["Product","Offer"]}' WHEN 4 THEN '{"@type":"FAQPage"}' WHEN 5 THEN '{"@type":"Service"}'
    WHEN 6 THEN '{"@type":"PostalAddress"}' WHEN 7 THEN '{"@graph":[{"@type":"WebSite"},{"@graph":[{"@type":"Organization"}]}]}' END AS jsonld"""


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test pages, some at addresses that tell what kind of page they are."""
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_URL).alias("url"), "html")


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page records: url, title, h1, status, meta values, JSON-LD, text and its words."""
    facts = site_pages(spark, sf_dir).selectExpr(*_split(_FACTS))
    html = F.col("html")
    pages = facts.withColumns(
        {
            "title": F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1),
            "h1": F.regexp_extract(html, "(?s)<h1[^>]*>(.*?)</h1>", 1),
            "text": t.body_text(html),
        }
    )
    length = F.col("page_id") % 140 + 40
    description = F.when(F.col("page_id") % 5 == 0, None).when(F.col("page_id") % 5 == 1, "").when(F.col("page_id") % 10 == 2, SAME).otherwise(
        F.substring(F.col("text"), F.lit(1), length.cast("int"))
    )
    none = F.array().cast("array<string>")
    turn, one = F.col("page_id") % 5, F.array("h1")
    h1s = F.when(turn == 0, none).when(turn == 1, one).when(turn == 2, F.array(F.col("h1"), F.lit("Short")))
    h1s = h1s.when(turn == 3, F.array("h1", "h1")).otherwise(F.array(F.concat(F.repeat(F.lit("long "), 20), F.col("page_id"))))
    return pages.withColumns({"description": description, "words": t.word_count(F.col("text")), "h1s": h1s})


def _split(columns: str) -> list[str]:
    """Column expressions of a select list; commas inside brackets or quotes do not end one."""
    out, depth, quoted, now = [], 0, False, ""
    for c in columns:
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                out.append(now.strip())
                now = ""
                continue
        now += c
    return [*out, now.strip()]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three links of each page, by arithmetic on page_id: src_id, src_url, pos, href, rel."""
    pages = site_pages(spark, sf_dir).select("page_id", "url")
    total = table(spark, sf_dir, "pages").agg(F.floor(F.count("*") * 0.9).cast("bigint").alias("linkable"))
    pos = F.explode(F.array(*[F.lit(k) for k in range(3)]))
    out = pages.select(F.col("page_id").alias("src_id"), F.col("url").alias("src_url"), pos.alias("pos"))
    out = out.join(F.broadcast(total))  # one row
    target = (F.col("src_id") * 31 + (F.col("src_id") % 7) * 13 + F.col("pos") * 11) % F.col("linkable")
    turn = (F.col("src_id") + F.col("pos")) % 3
    rel = F.when(turn == 0, "nofollow sponsored").when(turn == 1, "").otherwise("ugc")
    out = out.withColumn("to_id", target).withColumn("rel", rel)
    to = pages.select(F.col("page_id").alias("to_id"), F.col("url").alias("href"))
    return out.join(to, "to_id").select("src_id", "src_url", "pos", "href", "rel")


def recrawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three crawl days with some pages missing: url, crawl_date, line_no, status."""
    days = F.explode(F.array(F.lit(0), F.lit(10), F.lit(20)))
    out = table(spark, sf_dir, "pages").select("page_id", "url", days.alias("day")).where("(page_id + day) % 4 <> 0")
    return out.select(
        "url",
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("crawl_date"),
        (F.col("page_id") * 100 + 50 - F.col("day")).alias("line_no"),
        F.when((F.col("page_id") + F.col("day")) % 7 == 0, 404).otherwise(200).alias("status"),
    )


CTE = rf"""
site AS (SELECT page_id, {_URL} AS url, html FROM pages),
facts AS (SELECT {_FACTS} FROM site),
parsed AS (
  SELECT *, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
    regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h1,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)', 1),
      '(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text
  FROM facts),
crawl AS (
  SELECT *, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN '' WHEN page_id % 10 = 2 THEN '{SAME}'
      ELSE substring(text, 1, CAST(page_id % 140 + 40 AS INT)) END
      AS description, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS words,
    CASE page_id % 8 WHEN 1 THEN ['Article'] WHEN 2 THEN ['WebPage', 'BreadcrumbList'] WHEN 3 THEN ['Product', 'Offer']
      WHEN 4 THEN ['FAQPage'] WHEN 5 THEN ['Service'] WHEN 6 THEN ['PostalAddress'] WHEN 7 THEN ['WebSite'] ELSE CAST([] AS VARCHAR[]) END AS types,
    CASE page_id % 5 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [h1] WHEN 2 THEN [h1, 'Short'] WHEN 3 THEN [h1, h1]
      ELSE [repeat('long ', 20) || page_id] END AS h1s
  FROM parsed),
html_crawl AS (
  SELECT * FROM crawl WHERE coalesce(trim(content_type), '') = '' OR lower(content_type) LIKE '%text/html%'
    OR lower(content_type) LIKE '%application/xhtml%'),
audit_crawl AS (
  SELECT * FROM html_crawl WHERE NOT (lower(url) LIKE '%.pdf' OR coalesce(lower(content_type) LIKE '%application/pdf%', false))),
n AS (SELECT CAST(floor(count(*) * 0.9) AS BIGINT) AS linkable FROM pages),
edges AS (
  SELECT s.page_id AS src_id, s.url AS src_url, k.pos, d.url AS href,
    CASE (s.page_id + k.pos) % 3 WHEN 0 THEN 'nofollow sponsored' WHEN 1 THEN '' ELSE 'ugc' END AS rel
  FROM site s CROSS JOIN (VALUES (0), (1), (2)) AS k(pos) CROSS JOIN n
  JOIN site d ON d.page_id = (s.page_id * 31 + (s.page_id % 7) * 13 + k.pos * 11) % n.linkable),
recrawl AS (
  SELECT url, DATE '2024-01-01' + CAST(d.day AS INT) AS crawl_date, page_id * 100 + 50 - d.day AS line_no,
    CASE WHEN (page_id + d.day) % 7 = 0 THEN 404 ELSE 200 END AS status
  FROM pages CROSS JOIN (VALUES (0), (10), (20)) AS d(day) WHERE (page_id + d.day) % 4 <> 0)"""
