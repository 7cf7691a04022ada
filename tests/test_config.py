from __future__ import annotations

import pytest

from sitelume import __main__ as command
from sitelume import config


def test_file_environment_and_defaults(tmp_path):
    (tmp_path / "c.yml").write_text("targets:\n  allowedDomains: [a.cz]\ncrawler: {maxConcurrency: 4}\nextraction: {modules: {images: false}}\n")
    env = {"CRAWLER_ALLOWED_DOMAINS": "b.cz, a.cz,", "CRAWLER_START_URLS": "https://www.x.cz/", "CRAWLER_RESPECT_ROBOTS_TXT": "no"}
    got = config.load(str(tmp_path / "c.yml"), env)
    assert got.targets["allowedDomains"] == ["a.cz", "b.cz"]
    assert (got.crawler["maxConcurrency"], got.crawler["requestTimeoutSecs"]) == (4, 120)
    assert not got.extraction["modules"]["images"] and got.extraction["modules"]["links"]
    assert got.targets["respectRobotsTxt"] is False and got.targets["sitemapDiscovery"] is True
    assert (got.base_domain(), got.allowed_domains()) == ("www.x.cz", ["a.cz", "b.cz"])
    assert config.load(None, {}).allowed_domains() == ["example.com"]
    (tmp_path / "bad.yml").write_text("targets: [")
    assert config.load(str(tmp_path / "bad.yml"), {}).targets == config.DEFAULTS["targets"]


def test_validation():
    bad = config.from_mapping({"targets": {"startUrls": ["ftp://a.b", "nothing"]}, "crawler": {"maxConcurrency": 0, "requestTimeoutSecs": 0}})
    assert len(bad.problems()) == 4
    assert config.from_mapping({"targets": {"startUrls": []}}).problems()
    assert not config.from_mapping(None).problems()
    assert config.from_mapping(None).start_at("https://www.k.cz/x").targets["allowedDomains"] == ["k.cz", "www.k.cz"]


def test_actor_input():
    given = {"startUrls": [{"url": "https://a.cz"}], "extractionModules": {"links": False}, "performance": {"requestTimeoutSecs": 7}}
    got = config.from_actor(given, {"MAX_CONCURRENCY": "9", "DEBUG": "1", "SKIP_SITEMAP_DISCOVERY": "true"})
    assert got.targets["startUrls"] == ["https://a.cz"] and not got.targets["sitemapDiscovery"]
    assert (got.crawler["maxConcurrency"], got.crawler["requestTimeoutSecs"], got.crawler["requestDelayMax"]) == (9, 7, 6000)
    modules = got.extraction["modules"]
    assert not modules["links"] and not modules["pageMap"] and modules["seoTags"] and modules["images"]
    assert got.logging["level"] == "debug"
    with pytest.raises(ValueError):
        config.from_actor({}, {})


def test_commands(spark, tmp_path, capsys):
    folder = tmp_path / "e.com" / "05-01-2024"
    folder.mkdir(parents=True)
    page = '{"url":"https://e.com/%s","title":"T","response":{"status":%d,"headers":{"content-type":"text/html"}},"links":{"internal":[{"href":"https://e.com/b"}]}}'
    (folder / "crawl-data.jsonl").write_text("\n".join([page % ("a", 200), page % ("b", 404), page % ("a", 200)]) + "\n")
    command.main(["--format", "json", "--out", f"{tmp_path}/out", "report", "not-found", "--root", str(tmp_path), "--domain", "e.com"], spark)
    assert [(r.url, r.referrer) for r in spark.read.json(f"{tmp_path}/out").collect()] == [("https://e.com/b", "https://e.com/a")]
    (tmp_path / "index.json").write_text('{"urls":{"u":{"url":"https://e.com/a","status":"failed","domain":"e.com","retryCount":1},"v":{"url":"https://e.com/b","status":"completed"}}}')
    command.main(["index", "stats", "--path", f"{tmp_path}/index.json"], spark)
    assert "|2    |1        |1     |0      |" in capsys.readouterr().out
    command.main(["--format", "csv", "--out", f"{tmp_path}/retry", "index", "retry", "--path", f"{tmp_path}/index.json"], spark)
    assert spark.read.csv(f"{tmp_path}/retry", header=True).count() == 1
    (tmp_path / "map.xml").write_text("<urlset><url><loc>https://e.com/a</loc></url><url><loc>https://e.com/n</loc></url></urlset>")
    diff = ["--format", "json", "--out", f"{tmp_path}/diff", "sitemap-diff", "--current", f"{tmp_path}/map.xml", "--previous", f"{tmp_path}/none.json", "--index", f"{tmp_path}/index.json"]
    command.main(diff, spark)
    assert {(r.url, r["class"]) for r in spark.read.json(f"{tmp_path}/diff").collect()} == {("https://e.com/n", "new"), ("https://e.com/a", "modified")}
