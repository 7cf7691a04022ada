"""Command line: python -m sitelume report | index | sitemap-diff."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelume.functions import text as t
from sitelume.operators import audit, dedup, issues, links, sitemaps, state
from sitelume.session import build_session
from sitelume.sources import readers, sinks

DEFAULT_DIFF = "incremental"


def _pages(spark: SparkSession, root: str, domain: str) -> tuple[DataFrame, DataFrame]:
    """Flat pages and link edges of the latest record of each URL: by date, then by place in the file."""
    told = readers.read_pages(spark, readers.resolve_source(spark, root, domain), "tolerant")
    told = told.withColumn("at", F.monotonically_increasing_id())
    last = dedup.latest_wins(told.select("url", "crawl_date", "at"), ["url"], "crawl_date", "at")
    told = told.join(last.select("at"), "at", "left_semi")
    flat = readers.flatten(told)
    return flat.withColumn("types", audit.jsonld_types(F.col("blocks"))), readers.link_edges(told)


def reports(pages: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The reports over a crawl, by name."""
    html = issues.html_pages(pages)
    return {
        "titles": issues.value_issues(html, "title", issues.TITLE_CHARS, t.TITLE_PIXELS),
        "descriptions": issues.value_issues(html, "description", issues.DESCRIPTION_CHARS, t.DESCRIPTION_PIXELS),
        "open-graph": issues.open_graph(html),
        "twitter-card": issues.twitter_card_missing(html),
        "redirects": issues.redirects(pages),
        "orphans": links.orphans(edges, html),
        "not-found": links.referrers(edges, pages),
        "broken-links": links.broken_internal(edges, pages),
        "structured-data": audit.jsonld_issues(html),
        "audit-issues": audit.issue_counts(audit.analyse(issues.audit_pages(pages))),
    }


def index_answer(index: DataFrame, command: str, status: str | None, text: str | None, retries: int) -> DataFrame:
    """What the index command asks for: stats, list, search, export or retry."""
    if command == "stats":
        return state.index_stats(index)
    if command == "search":
        return state.search(index, text or "")
    if command == "retry":
        return state.retryable(index, retries)
    return index.where(F.col("status") == status) if status else index


def show(df: DataFrame, form: str, out: str | None) -> None:
    """To a folder as CSV or JSON lines, to one JSON file of the total and all rows, or the first rows to the screen."""
    if out and form == "document":
        sinks.report_document(df, out)
    elif out:
        sinks.index_json(df, out) if form == "json" else sinks.index_csv(df, out)
    else:
        df.show(50, truncate=False)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sitelume")
    parser.add_argument("--format", choices=("csv", "json", "document"), default="csv")
    parser.add_argument("--out")
    commands = parser.add_subparsers(dest="command", required=True)
    report = commands.add_parser("report", help="a report over the latest crawl of a domain")
    report.add_argument("name")
    report.add_argument("--root", required=True)
    report.add_argument("--domain", required=True)
    index = commands.add_parser("index", help="questions to a stored URL index")
    index.add_argument("ask", choices=("stats", "list", "search", "export", "retry"))
    index.add_argument("--path", required=True)
    index.add_argument("--status")
    index.add_argument("--search")
    index.add_argument("--max-retries", type=int, default=3)
    diff = commands.add_parser("sitemap-diff", help="what to crawl since the crawl before")
    diff.add_argument("--current", required=True, help="sitemap files, one XML document each")
    diff.add_argument("--previous", required=True, help="metadata of the crawl before")
    diff.add_argument("--index", help="its URL index, where there are no metadata")
    diff.add_argument("--mode", choices=tuple(sitemaps.MODES), default=DEFAULT_DIFF)
    diff.add_argument("--limit", type=int)
    args = parser.parse_args(argv)
    spark = spark or build_session("sitelume")
    if args.command == "report":
        known = reports(*_pages(spark, args.root, args.domain))
        if args.name not in known:
            parser.error(f"reports are {', '.join(sorted(known))}")
        answer = known[args.name]
    elif args.command == "index":
        answer = index_answer(readers.read_url_index(spark, args.path), args.ask, args.status, args.search, args.max_retries)
    else:
        files = spark.read.option("wholetext", True).text(args.current)
        current = sitemaps.entries(files.select(F.col("_metadata.file_path").alias("sitemap_url"), F.col("value").alias("xml")))
        before = readers.read_previous(spark, args.previous)
        known = before[1] if before else readers.read_url_index(spark, args.index).select("url", "status", "crawled_at")
        previous = sitemaps.previous_or_index(before[0] if before else None, known)
        answer = sitemaps.to_crawl(sitemaps.difference(current, previous, known, F.current_timestamp()), args.mode, args.limit)
    show(answer, args.format, args.out)


if __name__ == "__main__":
    main()
