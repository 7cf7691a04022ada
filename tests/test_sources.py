from __future__ import annotations

from datetime import date

import pytest

from sitelume.sources import readers, sinks


@pytest.fixture
def crawl(tmp_path):
    for day, lines in (("05-01-2024", ['{"url":"a","title":"old"}']), ("10-12-2023", ['{"url":"a","title":"older"}', '{"url":"b", broken'])):
        folder = tmp_path / "e.com" / day
        folder.mkdir(parents=True)
        (folder / "crawl-data.jsonl").write_text("\n".join(lines) + "\n")
    return tmp_path


def test_strict_fails_and_others_do_not(spark, crawl):
    bad = f"{crawl}/e.com/10-12-2023/crawl-data.jsonl"
    with pytest.raises(Exception):
        readers.read_pages(spark, bad).select("url", "title", "fullText").collect()
    assert [r.url for r in readers.read_pages(spark, bad, "tolerant").collect()] == ["a"]
    assert sorted(r.url for r in readers.read_pages(spark, bad, "salvage").collect()) == ["a", "b"]


def test_dates_are_chronological(spark, crawl):
    assert readers.crawl_dates(spark, f"{crawl}/e.com") == ["05-01-2024", "10-12-2023"]
    assert readers.resolve_source(spark, str(crawl), "e.com").endswith("05-01-2024/crawl-data.jsonl")
    told = readers.read_pages(spark, f"{crawl}/e.com/05-01-2024/crawl-data.jsonl").select("crawl_date").first()
    assert told[0] == date(2024, 1, 5)


def test_missing_source(spark, crawl):
    (crawl / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.resolve_source(spark, str(crawl), "none")


def test_purge(spark, crawl):
    today = date(2024, 1, 20)
    listed = sinks.purge(spark, str(crawl), 30, today).collect()
    assert [r.path for r in listed] == [f"{crawl}/e.com/10-12-2023"]
    assert (crawl / "e.com/10-12-2023").exists()
    sinks.purge(spark, str(crawl), 30, today, dry_run=False)
    assert not (crawl / "e.com/10-12-2023").exists()


def test_csv_round_trip(spark, tmp_path):
    rows = [('a "q"', ["x", "y"]), ("b,c", [])]
    sinks.report_csv(spark.createDataFrame(rows, "v string, l array<string>"), f"{tmp_path}/r")
    back = spark.read.csv(f"{tmp_path}/r", header=True, escape='"').collect()
    assert sorted((r.v, r.l or "") for r in back) == [('a "q"', "x | y"), ("b,c", "")]


def test_flatten_feeds_the_audit(spark, tmp_path):
    from pyspark.sql import functions as F

    from sitelume.operators import audit

    (tmp_path / "p.jsonl").write_text(
        '{"url":"https://e.com/faq","title":"T","response":{"status":200},"seo":{"metaTags":{"description":"d"}},'
        '"aiMetadata":{"structuredData":{"jsonLd":[{"@type":["A","B"]},{"@graph":[{"@type":"C"}]}]}},"fullText":"one two"}\n'
        '{"url":"https://e.com/x"}\n'
    )
    flat = readers.flatten(readers.read_pages(spark, f"{tmp_path}/p.jsonl"))
    rows = audit.analyse(flat.withColumn("types", audit.jsonld_types(F.col("blocks")))).orderBy("url").collect()
    assert [(r.page_type, r.words, r.has_description, sorted(r.types)) for r in rows] == [("FAQ", 2, True, ["A", "B", "C"]), ("Generic", 0, False, [])]


def test_localised():
    assert sinks.localised("report.csv", "en") == "report.csv"
    assert sinks.localised("report.csv", "cs") == "report-cs.csv"
