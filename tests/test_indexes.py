"""Lists of domains, paths and robots rules as tables, against the plain rules."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from sitelume import config as settings
from sitelume.functions import urls
from sitelume.operators import crawl, filters, probes, robots

NAMES = ["example.com", "www.example.com", "a.example.com", "www.a.example.com", "b.a.example.com", "ample.com", "com", "x.cz", "www.x.cz", "localhost", "", ".", "a..b", "www."]


def test_hosts_equal_the_expressions(spark):
    draw = random.Random(1)
    labels = ["a", "b", "www", "x", "com", "cz"]
    names = NAMES + [".".join(draw.choices(labels, k=draw.randrange(1, 5))) for _ in range(300)]
    hosts = spark.createDataFrame([(n,) for n in names] + [(None,)], "host string")
    for k in range(6):
        listed = draw.sample(names, 12)
        domains = spark.createDataFrame([(d,) for d in listed], "domain string")
        for table, plain in ((filters.allowed_hosts, urls.allows), (filters.excluded_hosts, urls.excludes)):
            want = {r.host for r in hosts.where(plain(F.col("host"), listed)).collect()}
            assert {r.host for r in table(hosts, domains).collect()} == want, (k, listed)


def test_paths_equal_the_expressions(spark):
    draw = random.Random(2)
    paths = ["", "/", *("/" + "".join(draw.choices("ab/", k=draw.randrange(6))) for _ in range(200))]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for prefixes in (["/a", "/bb/", "/b"], [""], []):
        found = filters.paths_under(df, spark.createDataFrame([(p,) for p in prefixes], "prefix string"))
        assert {r.path for r in found.collect()} == {p for p in paths if any(p.startswith(x) for x in prefixes)}


def test_long_lists_give_what_short_ones_do_and_a_small_plan(spark, monkeypatch):
    rows = [f"https://{h}{p}" for h in ("www.e.com", "e.com", "cdn.e.com", "o.org", "s1.bad.e.com") for p in ("/", "/private/x", "/p1/y", "/open")]
    links = spark.createDataFrame([(u,) for u in rows] * 2 + [("mailto:a@e.com",), ("x",), (None,)], "url string")
    base = {"startUrls": ["https://www.e.com/"], "excludedDomains": ["cdn.e.com", "bad.e.com"], "excludedPaths": ["/private", "/p1"]}
    plain = crawl.followed(links, settings.from_mapping({"targets": base}))
    long = dict(base, excludedDomains=base["excludedDomains"] + [f"d{k}.other.net" for k in range(10_000)], excludedPaths=base["excludedPaths"] + [f"/q{k}/" for k in range(3000)])
    indexed = crawl.followed(links, settings.from_mapping({"targets": long}))
    assert sorted(r.url for r in indexed.collect()) == sorted(r.url for r in plain.collect()) and plain.count() > 0
    some = dict(long, excludedDomains=long["excludedDomains"][:100], excludedPaths=long["excludedPaths"][:100])
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(indexed) < 1.02 * size(crawl.followed(links, settings.from_mapping({"targets": some})))
    monkeypatch.setattr(crawl, "SHORT", 0)
    assert sorted(r.url for r in crawl.followed(links, settings.from_mapping({"targets": base})).collect()) == sorted(r.url for r in plain.collect())


def test_robots_equal_the_rule(spark):
    draw = random.Random(3)
    make = lambda: "/" + "".join(draw.choices("ab/?", k=draw.randrange(6)))
    rules = [(d, draw.choice(["allow", "disallow", "sitemap"]), make()) for d in ("x.com", "y.com") for _ in range(25)]
    pages = [(f"https://{d}{make()}", d) for d in ("x.com", "y.com", "z.com") for _ in range(150)] + [(None, "x.com"), ("https://x.com/a", None)]
    got = robots.allowed(spark.createDataFrame(pages, "url string, domain string"), spark.createDataFrame(rules, "domain string, kind string, pattern string"))
    rows = got.select("url", "domain", "is_allowed", F.concat(urls.path(F.col("url")), urls.query(F.col("url"))).alias("t")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        longest = {k: max([len(p) for d, kind, p in rules if d == r.domain and kind == k and (r.t or "").startswith(p)], default=-1) for k in ("allow", "disallow")}
        assert r.is_allowed == (r.t is None or longest["disallow"] == -1 or longest["allow"] > longest["disallow"]), r


def test_many_rules_of_one_domain(spark):
    """10**5 rules of one domain and 10**5 of its pages."""
    n = 100_000
    rules = spark.range(n).select(F.lit("x.com").alias("domain"), F.when(F.col("id") % 2 == 0, "disallow").otherwise("allow").alias("kind"), F.concat(F.lit("/p/"), "id").alias("pattern"))
    pages = spark.range(n).select(F.concat(F.lit("https://x.com/p/"), F.col("id") * 7, F.lit("/")).alias("url"), F.lit("x.com").alias("domain"))
    began = time.perf_counter()
    assert robots.allowed(pages, rules).count() == n
    assert time.perf_counter() - began < 60


def test_broken_targets_are_in_the_order_of_a_language(spark):
    names = ["https://e.com/B", "https://e.com/a", "https://e.com/é", "https://e.com/z", "https://e.com/E", "https://e.com/b"]
    targets = spark.createDataFrame([(u, "internal-link", 1) for u in names], "url string, kinds string, referrers long")
    found = probes.broken(targets, spark.createDataFrame([(u, 404) for u in names], "url string, status int"), "e.com")
    assert [r.url[-1] for r in found.collect()] == ["a", "b", "B", "E", "é", "z"]
