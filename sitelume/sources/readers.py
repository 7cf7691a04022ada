"""Readers of crawl output: page records, indexes, logs, keyword exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelume.operators import keywords

from .schema import CRAWL_METADATA, PAGE, REQUEST_LOG, URL_INDEX

DATE_FOLDER = r"/(\d{2}-\d{2}-\d{4})/[^/]*$"


def read_pages(spark: SparkSession, path: str | list[str], mode: str = "strict") -> DataFrame:
    """Page records of JSON lines.

    strict: a bad line fails the job. tolerant: bad lines are dropped. salvage:
    of a bad line the URL is kept, where one can be found. Every record gets
    crawl_date, from a DD-MM-YYYY folder of its file, and source_file.
    """
    if mode == "strict":
        pages = spark.read.schema(PAGE).option("mode", "FAILFAST").json(path)
    elif mode == "tolerant":
        pages = spark.read.schema(PAGE).option("mode", "DROPMALFORMED").json(path)
    elif mode == "salvage":
        told = spark.read.schema(f"{PAGE}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
        found = F.nullif(F.regexp_extract("_bad", r'"url"\s*:\s*"([^"]+)"', 1), F.lit(""))
        pages = told.withColumn("url", F.coalesce("url", found)).where("_bad IS NULL OR url IS NOT NULL").drop("_bad")
    else:
        raise ValueError(f"mode is strict, tolerant or salvage, not {mode!r}")
    file = F.col("_metadata.file_path")
    return pages.withColumns(
        {"crawl_date": F.try_to_date(F.regexp_extract(file, DATE_FOLDER, 1), "dd-MM-yyyy"), "source_file": file}
    )


def read_page_files(spark: SparkSession, folder: str) -> DataFrame:
    """Page records of a folder with one JSON object in each file."""
    return spark.read.schema(PAGE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)


def crawl_dates(spark: SparkSession, domain_folder: str) -> list[str]:
    """DD-MM-YYYY folders of a domain, the latest first, by the file system the path names."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(domain_folder)
    names = [s.getPath().getName() for s in path.getFileSystem(hadoop).listStatus(path) if s.isDirectory()]
    dated = [n for n in names if len(n) == 10 and n[2] == n[5] == "-" and n.replace("-", "").isdigit()]
    return sorted(dated, key=lambda n: (n[6:], n[3:5], n[:2]), reverse=True)


def resolve_source(spark: SparkSession, root: str, domain: str) -> str:
    """The merged file of a domain, else the page file of its latest crawl, under either of its names."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = domain.replace(".", "_")
    places = [f"{root}/{name}.jsonl"]
    places += [f"{root}/{domain}/{d}/{n}" for d in crawl_dates(spark, f"{root}/{domain}")[:1] for n in (f"{name}.jsonl", "crawl-data.jsonl")]
    for place in places:
        path = jvm.org.apache.hadoop.fs.Path(place)
        if path.getFileSystem(hadoop).exists(path):
            return place
    raise FileNotFoundError(f"no page records of {domain} below {root}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_url_index(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a stored index, one row each; its redundant maps are not read."""
    told = spark.read.schema(f"urls map<string,struct<{URL_INDEX.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    return told.select(F.explode("urls").alias("key", "entry")).select(
        F.coalesce("entry.url", "key").alias("url"), "entry.id", "entry.status", "entry.domain",
        F.col("entry.retryCount").alias("retry_count"), F.col("entry.timestamp").try_cast("timestamp").alias("crawled_at"), "entry.error",
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    told = spark.read.schema(REQUEST_LOG).json(path)
    return told.withColumn("ts", F.timestamp_millis("timestamp"))


def keyword_file(spark: SparkSession, folder: str) -> str | None:
    """The first .csv or .tsv file of a folder by name."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(hadoop)
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isFile()) if fs.exists(path) else []
    return next((f"{folder}/{n}" for n in names if n.lower().endswith((".csv", ".tsv"))), None)


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated keyword export without its first line; short lines and blank keywords are dropped."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    return keywords.parse(lines.where("at <> 0"))  # the file begins the first partition


def read_previous(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Sitemap (url, lastmod) and index (url, status, crawled_at) of the metadata of a crawl; None if there is no such file."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(hadoop).exists(place):
        return None
    told = spark.read.schema(CRAWL_METADATA).option("multiLine", True).json(path)
    listed = told.select(F.explode("sitemapUrls").alias("s")).select("s.url", "s.lastmod")
    index = told.select(F.explode("urlIndex").alias("url", "e"))
    return listed, index.select("url", "e.status", F.col("e.timestamp").try_cast("timestamp").alias("crawled_at"))


def flatten(pages: DataFrame) -> DataFrame:
    """Page records as the flat columns that the audit reads."""
    meta: Column = F.col("seo.metaTags")
    return pages.select(
        "url",
        "title",
        F.col("response.status").alias("status"),
        F.coalesce(F.col("response.headers")["content-type"], F.col("response.headers")["Content-Type"]).alias("content_type"),
        F.col("response.url").alias("final_url"),
        meta["robots"].alias("robots"),
        meta["description"].alias("description"),
        F.col("seo.specialLinks.canonical").alias("canonical"),
        *[meta[f"og:{k}"].alias(f"og_{k}") for k in ("title", "description", "image", "url")],
        meta["twitter:card"].alias("twitter_card"),
        F.get(F.filter("seo.specialLinks.alternate", lambda a: (a["hreflang"] != "") & (a["hreflang"] != "x-default")), F.lit(0))["hreflang"].alias("hreflang"),
        F.coalesce(F.size(F.filter("seo.specialLinks.alternate", lambda a: a["hreflang"] != "")), F.lit(0)).alias("hreflang_count"),
        F.coalesce(F.transform("aiMetadata.structuredData.jsonLd", lambda b: F.to_json(b)), F.array().cast("array<string>")).alias("blocks"),
        F.coalesce(
            F.col("aiMetadata.customMetadata.wordCount"), F.size(F.filter(F.split("fullText", r"\s+"), lambda w: w != "")), F.lit(0)
        ).cast("bigint").alias("words"),
        F.coalesce(F.size("links.internal"), F.lit(0)).alias("internal_links"),
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """Internal link occurrences of page records: src_url, src_title, pos, href, rel."""
    rows = pages.select(F.col("url").alias("src_url"), F.col("title").alias("src_title"), F.posexplode("links.internal").alias("pos", "l"))
    return rows.select("src_url", "src_title", "pos", "l.href", "l.rel")
