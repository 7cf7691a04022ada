"""Writers of reports and tables, and the purge of old partitions."""

from __future__ import annotations

import json
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sitelume.functions import text as t
from sitelume.operators import audit, issues, keywords, links
from sitelume.session import shared_folder

from .readers import crawl_dates


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


COPY_BYTES = 4 << 20
PARTITIONS = ["domain", "crawl_date"]


def write_lake(pages: DataFrame, path: str) -> None:
    """Page records as Parquet by domain and crawl date, so that reports prune what they don't read.

    Partitions that `pages` has rows of are replaced, others stay, so writing the
    same records again changes nothing. Large partitions are several files.
    """
    told = pages.hint("rebalance", *PARTITIONS)
    told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def merge_lake(pages: DataFrame, path: str, order: str = "timestamp") -> None:
    """Add page records to a lake: of a URL and crawl date the record of the latest `order` stays (a new one on ties), equal records once.

    Only partitions that `pages` has rows of are read and replaced. What is to
    stand there is written to the shared folder first, so a run that fails in
    between leaves the lake as it was and can be run again.
    """
    spark = pages.sparkSession
    told = pages.withColumn("_is_new", F.lit(1))
    if _exists(spark, path):
        old = spark.read.parquet(path)
        kinds = {c: pages.schema[c].dataType for c in PARTITIONS}
        old = old.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in old.columns])
        touched = pages.select(*PARTITIONS).distinct()
        told = told.unionByName(old.join(touched, PARTITIONS, "left_semi").withColumn("_is_new", F.lit(0)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*PARTITIONS, "url").orderBy(F.desc_nulls_last(order), F.desc("_is_new")))
    folder = shared_folder(spark, "lake")
    told.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_is_new").write.parquet(folder)
    write_lake(spark.read.schema(told.drop("_is_new").schema).parquet(folder), path)
    _hadoop(spark, folder)[0].delete(_hadoop(spark, folder)[1], True)


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    fs, place = _hadoop(spark, path)
    return fs.exists(place)


def report_csv(df: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled, arrays joined by ' | '."""
    flat = [
        F.array_join(F.col(c).cast("array<string>"), " | ").alias(c) if kind.startswith("array") else F.col(c)
        for c, kind in df.dtypes
    ]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def report_json(df: DataFrame, path: str, name: str = "issues") -> None:
    """One line of JSON for each issue and, beside it, the total; a report of any size is written in parts."""
    df.write.mode("overwrite").json(f"{path}/{name}")
    df.agg(F.count("*").alias("total")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def report_document(df: DataFrame, path: str, *order: str, name: str = "issues") -> None:
    """One JSON file at `path`, {"total": n, <name>: [...]}, a line for each row in the `order` of columns.

    Rows are sorted and turned to JSON in parts by all tasks. As most stores
    let a file have one writer only, the parts are then copied one after the
    other through a buffer of fixed size, so a report of any size needs no more
    memory. The file appears under its name when it is whole; an earlier one is
    replaced. Keys of null values are left out, as in `report_json`.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "document")
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    # only the first row of a part has no comma before it
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines = (df.orderBy(*order) if order else df).select(F.concat(F.when(first, "").otherwise(","), row).alias("value"))
    counted = Observation()
    lines.observe(counted, F.count("*").alias("total")).write.option("maxRecordsPerFile", 0).text(folder)
    fs, parts = _hadoop(spark, folder)
    target_fs, target = _hadoop(spark, path)
    _, unfinished = _hadoop(spark, f"{path}.unfinished")
    files = sorted((f for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getPath().getName())
    jvm = spark.sparkContext._jvm
    out = target_fs.create(unfinished, True)
    try:
        out.writeBytes(f'{{"total":{counted.get["total"]},{json.dumps(name)}:[\n')
        for k, part in enumerate(files):
            out.writeBytes("," if k else "")
            source = fs.open(part.getPath())
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, COPY_BYTES, False)
            finally:
                source.close()
        out.writeBytes("]}\n")
    finally:
        out.close()
    target_fs.delete(target, False)
    target_fs.rename(unfinished, target)
    fs.delete(parts, True)


def not_found_csv(referrers: DataFrame, path: str) -> None:
    """A row for each page not found and page that links to it (`links.referrers`); the origin of those without one."""
    origin = F.when(F.col("referrer").isNull(), "seeded_or_sitemap").otherwise("linked")
    report_csv(referrers.select("url", "referrer", origin.alias("origin")), path)


def broken_csv(broken: DataFrame, references: DataFrame, path: str) -> None:
    """A row for each broken target (`probes.broken`) and reference to it (`probes.target_rows`)."""
    rows = references.join(broken.select("url", "status"), "url")
    report_csv(rows.select("url", F.coalesce(F.col("status").cast("string"), F.lit("ERR")).alias("status"), "kind", "src_url"), path)


def index_csv(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def index_json(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").json(path)


def merged_jsonl(spark: SparkSession, files: list[str], path: str, keep_unreadable: bool = False) -> None:
    """All lines of page files as they are, in one place; unreadable ones are dropped, or kept."""
    lines = spark.read.text(files).where("trim(value) <> ''")
    if not keep_unreadable:
        lines = lines.where(F.try_parse_json("value").isNotNull())
    lines.write.mode("overwrite").text(path)


def localised(name: str, language: str) -> str:
    """File name with the suffix of a language other than English."""
    stem, dot, end = name.rpartition(".")
    return name if language == "en" else f"{stem}-{language}{dot}{end}" if dot else f"{name}-{language}"


def old_partitions(spark: SparkSession, root: str, days: int, today: date) -> list[str]:
    """Crawl folders below `root`/<domain> older than `days`."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    out = []
    for status in path.getFileSystem(hadoop).listStatus(path):
        if status.isDirectory():
            domain = f"{root}/{status.getPath().getName()}"
            for name in crawl_dates(spark, domain):
                d, m, y = map(int, name.split("-"))
                if date(y, m, d) < today - timedelta(days=days):
                    out.append(f"{domain}/{name}")
    return sorted(out)


def purge(spark: SparkSession, root: str, days: int, today: date, dry_run: bool = True) -> DataFrame:
    """Delete crawl folders older than `days`: path and bytes of each; a dry run only lists them."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for place in old_partitions(spark, root, days, today):
        path = jvm.org.apache.hadoop.fs.Path(place)
        fs = path.getFileSystem(hadoop)
        rows.append((place, fs.getContentSummary(path).getLength()))
        if not dry_run:
            fs.delete(path, True)
    return spark.createDataFrame(rows, "path string, bytes long")


def _table(df: DataFrame) -> list[str]:
    """Lines of a Markdown table of a small frame."""
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return head + ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in df.collect()]


def audit_markdown(title: str, sections: list[tuple[str, DataFrame]]) -> str:
    """A report of small tables (counts, never pages), a section each."""
    lines = [f"# {title}"]
    for k, (name, df) in enumerate(sections, 1):
        lines += ["", f"## {k}. {name}", "", *_table(df)]
    return "\n".join(lines) + "\n"


def audit_report(analysis: DataFrame, pages: DataFrame, edges: DataFrame, path: str, title: str, keyword_rows: DataFrame | None = None) -> str:
    """The whole audit below `path`: summary (text) with the counted sections, and a folder of lines for each list of pages.

    Lists may be as long as the crawl, so they are written in parts. Returns the summary.
    """
    analysis = analysis.select("*", F.exists("issues", lambda i: i["severity"] == "critical").alias("is_critical"))
    found = links.audit_broken(edges, pages)
    sections = [
        ("Executive summary", audit.executive_summary(analysis)),
        ("Scope", audit.type_histogram(analysis).orderBy(F.desc("pages"))),
        ("Page inventory", analysis.groupBy("page_type", "indexable").agg(F.count("*").alias("pages"), F.count_if("is_critical").alias("critical")).orderBy("page_type", "indexable")),
        ("Structured data", audit.schema_types(analysis).orderBy(F.desc("pages"), "type")),
        ("Technical coverage", audit.meta_coverage(analysis)),
        ("Entities", audit.schema_coverage(analysis).orderBy("page_type")),
        ("Gaps", audit.gap_analysis(analysis).orderBy("page_type", "type")),
        ("Content", audit.word_histogram(analysis)),
        ("Internal linking", links.link_stats(analysis)),
        ("Broken links", found.groupBy("status").agg(F.count("*").alias("pages"), F.sum("found_on").alias("links")).orderBy("status")),
        ("Validation plan", audit.priority_pages(analysis)),
        ("Roadmap", audit.roadmap(analysis)),
        ("Issues", audit.issue_counts(analysis).orderBy("severity", "code")),
    ]
    if keyword_rows is not None:
        sections.append(("Keywords", keywords.summary(keyword_rows)))
    link = t.markdown_link(F.col("url"))
    issue = F.array_join(F.transform("issues", lambda i: F.concat(i["severity"], F.lit(": "), i["code"])), "; ")
    lists = {
        "inventory": analysis.select(F.concat_ws(" | ", link, "page_type", F.col("indexable").cast("string"), F.array_join("types", ", "))),
        "thin": analysis.where(f"words > 0 AND words < {audit.THIN_WORDS}").select(F.concat_ws(" - ", link, "words")),
        "without-links": analysis.where("internal_links = 0").select(link),
        "broken": links.backlinks(edges, pages).select(F.concat_ws(" - ", link, "status", t.markdown_escape(F.col("found_on")))),
        "pdf": issues.pdf_pages(pages).select(F.concat_ws(" - ", link, "status")),
        "issues": analysis.where(F.size("issues") > 0).select(F.concat_ws(" - ", link, issue)),
    }
    for name, lines in lists.items():
        lines.toDF("value").write.mode("overwrite").text(f"{path}/{name}")
    text = audit_markdown(title, sections)
    spark = analysis.sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")
    return text
