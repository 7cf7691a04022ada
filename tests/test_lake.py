"""Lakes, merged files, alerts and the readers of what a crawl leaves behind."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from sitelume.operators import audit
from sitelume.plans import crawl_queries, fixtures
from sitelume.sources import readers, sinks
from sitelume.streaming import state as stream

SCHEMA = "url string, domain string, crawl_date date, timestamp string, status int"


def records(spark, rows):
    return spark.createDataFrame([(u, d, date(2024, 1, day), ts, s) for u, d, day, ts, s in rows], SCHEMA)


FIRST = [("a", "e.com", 1, "1", 200), ("b", "e.com", 1, "1", 200), ("c", "e.com", 2, "1", 200), ("a", "o.org", 1, "1", 404)]


def lake(spark, path):
    return sorted((r.url, r.domain, r.crawl_date.day, r.timestamp, r.status) for r in spark.read.parquet(path).collect())


@pytest.mark.parametrize("write", [sinks.write_lake, sinks.merge_lake])
def test_writing_twice_changes_nothing(spark, tmp_path, write):
    for _ in range(2):
        write(records(spark, FIRST), f"{tmp_path}/lake")
        assert lake(spark, f"{tmp_path}/lake") == sorted(FIRST)


def test_merge_keeps_the_latest_and_what_it_does_not_touch(spark, tmp_path):
    path = f"{tmp_path}/lake"
    sinks.write_lake(records(spark, FIRST), path)
    untouched = sorted(p.name for p in (tmp_path / "lake/domain=e.com/crawl_date=2024-01-02").iterdir())
    sinks.merge_lake(records(spark, [("a", "e.com", 1, "2", 500), ("b", "e.com", 1, "0", 500), ("d", "e.com", 1, None, 200), ("a", "new.com", 3, "1", 200)]), path)
    want = [("a", "e.com", 1, "2", 500), ("b", "e.com", 1, "1", 200), ("d", "e.com", 1, None, 200), ("a", "new.com", 3, "1", 200), *FIRST[2:]]
    assert list(map(str, lake(spark, path))) == sorted(map(str, want))
    assert sorted(p.name for p in (tmp_path / "lake/domain=e.com/crawl_date=2024-01-02").iterdir()) == untouched


def test_readers_prune_partitions(spark, tmp_path):
    sinks.write_lake(records(spark, FIRST), f"{tmp_path}/lake")
    one = spark.read.parquet(f"{tmp_path}/lake").where("domain = 'e.com' AND crawl_date = DATE'2024-01-02'")
    assert "PartitionFilters: [isnotnull(domain" in one._jdf.queryExecution().executedPlan().toString()
    assert [f for f in one.inputFiles() if "crawl_date=2024-01-02" in f] and [r.url for r in one.collect()] == ["c"]


def test_jsonl_is_appended_and_merged(spark, tmp_path):
    for k in range(2):
        sinks.append_jsonl(spark.createDataFrame([(f"u{k}", k)], "url string, n int"), f"{tmp_path}/in")
    (tmp_path / "bad.jsonl").write_text('{"url":"u2"}\n{"url": broken\n\n')
    sinks.merged_jsonl(spark, [f"{tmp_path}/in", f"{tmp_path}/bad.jsonl"], f"{tmp_path}/out")
    assert sorted(json.loads(r.value)["url"] for r in spark.read.text(f"{tmp_path}/out").collect()) == ["u0", "u1", "u2"]
    sinks.merged_jsonl(spark, [f"{tmp_path}/in", f"{tmp_path}/bad.jsonl"], f"{tmp_path}/out", keep_unreadable=True)
    assert spark.read.text(f"{tmp_path}/out").count() == 4


def test_one_document_of_any_size(spark, tmp_path):
    path = f"{tmp_path}/report.json"
    rows = spark.range(200_000, numPartitions=7).select(F.concat(F.lit('"\n'), "id").alias("url"), F.array(F.col("id") % 3).alias("n"), F.when(F.col("id") % 2 == 0, "x").alias("issue"))
    sinks.report_document(spark.range(3).toDF("old"), path)
    sinks.report_document(rows, path, "url", name="all")
    told = json.loads((tmp_path / "report.json").read_text())
    want = sorted(f'"\n{k}' for k in range(200_000))
    assert told["total"] == 200_000 and [r["url"] for r in told["all"]] == want
    assert all(r.get("issue") == ("x" if int(r["url"][2:]) % 2 == 0 else None) for r in told["all"])
    assert not (tmp_path / "report.json.unfinished").exists()


@pytest.mark.parametrize("rows", [[], [(1,)], [(1,)] * 5])
def test_small_documents(spark, tmp_path, rows):
    sinks.report_document(spark.createDataFrame(rows, "`a.b` int").repartition(9), f"{tmp_path}/r.json", "`a.b`")
    assert json.loads((tmp_path / "r.json").read_text()) == {"total": len(rows), "issues": [{"a.b": 1}] * len(rows)}


def test_alerts_are_written_once(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = stream.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    for _ in range(2):  # the second start finds nothing new
        stream.write_alerts(source, f"{tmp_path}/out", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.key for r in spark.read.json(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_what_a_crawl_leaves_behind(spark, tmp_path):
    (tmp_path / "requests.jsonl").write_text('{"timestamp":1704067200000,"url":"u"}\n')
    assert readers.read_requests(spark, f"{tmp_path}/requests.jsonl").select(F.unix_millis("ts")).first()[0] == 1704067200000
    meta = {
        "sitemapUrls": [{"url": "a", "lastmod": "2024-01-01"}, {"url": "b"}],
        "urlIndex": {"a": {"status": "completed", "timestamp": "2024-01-02T00:00:00.000Z"}, "c": {"status": "failed", "timestamp": "?"}},
    }
    (tmp_path / "meta.json").write_text(json.dumps(meta, indent=1))
    listed, index = readers.read_previous(spark, f"{tmp_path}/meta.json")
    assert sorted(map(tuple, listed.collect()), key=str) == [("a", "2024-01-01"), ("b", None)]
    assert {r.url: (r.status, r.crawled_at is None) for r in index.collect()} == {"a": ("completed", False), "c": ("failed", True)}
    assert readers.read_previous(spark, f"{tmp_path}/none.json") is None


def test_keyword_file_is_the_first_by_name(spark, tmp_path):
    assert readers.keyword_file(spark, f"{tmp_path}/none") is None
    for name in ("b.csv", "a.TSV", "a.txt"):
        (tmp_path / name).write_text("head\n")
    (tmp_path / "0.csv").mkdir()
    assert readers.keyword_file(spark, str(tmp_path)) == f"{tmp_path}/a.TSV"
    line = "\t".join(["word", "word", "2024-01-01", "10", "20", "3", "-1", "", "", "https://e/", "", "", "tag"])
    (tmp_path / "a.TSV").write_text("head\n" + line + "\nshort\n")
    assert readers.read_keywords(spark, f"{tmp_path}/a.TSV").count() == 1


def test_whole_audit_report(spark, data, tmp_path):
    pages, edges = fixtures.crawl(spark, data), fixtures.edges(spark, data)
    analysis = crawl_queries.analysis(spark, data)
    text = sinks.audit_report(analysis, pages, edges, str(tmp_path), "Audit of a site")
    assert text.startswith("# Audit of a site\n") and text.count("\n## ") == 13
    assert "\n".join(r.value for r in spark.read.text(f"{tmp_path}/summary").collect()).rstrip("\n") == text.rstrip("\n")
    inventory = spark.read.text(f"{tmp_path}/inventory")
    assert inventory.count() == analysis.count() and inventory.first().value.startswith("[")
    thin = analysis.where(f"words > 0 AND words < {audit.THIN_WORDS}").count()
    assert spark.read.text(f"{tmp_path}/thin").count() == thin
    broken = spark.read.text(f"{tmp_path}/broken").count()
    assert broken > 0 and "| Broken links" not in text
