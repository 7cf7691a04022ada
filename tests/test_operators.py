from __future__ import annotations

import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sitelume.operators import audit, dedup, groups, hrefs, html, issues, keywords, links, llm_text, probes, robots, sitemaps, state
from sitelume.sources import sinks


def pages(spark, rows):
    return spark.createDataFrame(rows, "url string, title string, status int")


def edges(spark, rows):
    return spark.createDataFrame(rows, "src_url string, pos int, href string, rel string")


def test_uncrawled_targets_are_not_broken(spark):
    p = pages(spark, [("a", "A", 200), ("b", "B", 404)])
    e = edges(spark, [("a", 0, "b", ""), ("a", 1, "b", ""), ("a", 2, "zzz", "")])
    assert sorted(links.broken_internal(e, p).select("src_url", "pos", "href").collect()) == [("a", 0, "b"), ("a", 1, "b")]


def test_redirect_bounds(spark):
    p = pages(spark, [("a", "", 299), ("b", "", 300), ("c", "", 399), ("d", "", 400)])
    assert sorted(r.url for r in links.orphaned_redirects(edges(spark, [("b", 0, "b", "")]), p).collect()) == ["b", "c"]


def test_dofollow(spark):
    rels = spark.createDataFrame([("nofollow",), ("sponsored ugc",), ("NoFollow x",), (None,)], "rel string")
    assert [r[0] for r in rels.select(links.is_dofollow(F.col("rel"))).collect()] == [False, True, False, True]


def test_latest_wins(spark):
    rows = [("u", date(2024, 1, 2), 1), ("u", None, 9), ("u", date(2024, 1, 2), 5), (None, None, 1)]
    df = spark.createDataFrame(rows, "url string, day date, line int")
    assert dedup.latest_wins(df, ["url"], "day", "line").collect() == [("u", date(2024, 1, 2), 5)]
    assert sorted(r.line for r in dedup.merge_dedup(df, "url", "line").collect()) == [1, 9]


def test_duplicates_and_lengths(spark):
    p = pages(spark, [("a", "T" * 30, 200), ("b", "T" * 30, 200), ("c", "", 200), ("d", None, 200), ("e", "W" * 40, 200)])
    got = {(r.url, r.issue) for r in issues.value_issues(p, "title", issues.TITLE_CHARS, 579).collect()}
    assert got == {("a", "duplicate"), ("b", "duplicate"), ("c", "missing"), ("d", "missing"), ("e", "pixel_too_long")}


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        ("User-agent: *\nDisallow: /a\nAllow: /a/b", (["/a"], ["/a/b"])),
        ("User-agent: x\nUser-agent: SEO\nDisallow: /p", (["/p"], [])),
        ("User-agent: c\nDisallow: /p", ([], [])),
        ("User-agent: *\nCrawl-delay: 1\nUser-agent: other\nDisallow: /p", ([], [])),
        ("User-agent:\nDisallow: /p", ([], [])),
        ("Disallow: /early\nUser-agent: *\nDisallow:", ([], [])),
        ("", ([], [])),
    ],
)
def test_robots_parse(content, expected):
    rules = robots.parse(content)
    assert (rules["disallow"], rules["allow"]) == expected


def test_robots_longest_match(spark):
    rules = spark.createDataFrame(
        [("d", "disallow", "/a"), ("d", "allow", "/a/b"), ("d", "disallow", "/t"), ("d", "allow", "/t")],
        "domain string, kind string, pattern string",
    )
    p = spark.createDataFrame([(f"https://d{x}", "d") for x in ("/a", "/a/b", "/t", "/z")] + [("https://e/a", "e")], "url string, domain string")
    got = {r.url: r.is_allowed for r in robots.allowed(p, rules).collect()}
    assert got == {"https://d/a": False, "https://d/a/b": True, "https://d/t": False, "https://d/z": True, "https://e/a": True}


def test_sitemap_recursion_ends(spark):
    index = "<sitemapindex><sitemap><loc> {} </loc></sitemap></sitemapindex>"
    maps = spark.createDataFrame([("a", index.format("b")), ("b", index.format("a")), ("c", "")], "sitemap_url string, xml string")
    seeds = spark.createDataFrame([("a",)], "sitemap_url string")
    assert sorted(r[0] for r in sitemaps.reachable(maps, seeds).collect()) == ["a", "b"]


def test_sitemap_xml_is_escaped(spark):
    row = sitemaps.to_xml(spark.createDataFrame([("https://a/?x=1&y=<2>",), ("https://a/?x=1&y=<2>",)], "url string"), "2024-01-01").collect()
    assert len(row) == 1
    assert "https://a/?x=1&amp;y=&lt;2&gt;" in row[0][0]


def test_anchor_attributes(spark):
    page = '<a data-href="x">no</a><a HREF=\'y\'>y</a><a href>bare</a><abbr href="">t</abbr><a href=" # ">h</a>'
    found = hrefs.findings(hrefs.anchors(spark.createDataFrame([("u", page)], "url string, html string")))
    assert [(r.pos, r.category) for r in found.orderBy("pos").collect()] == [(0, "missing"), (2, "empty"), (3, "hash")]


def test_limiter_forgets_rejected_hits():
    assert state.admit([0, 1, 2, 10, 11, 12], 2, 10) == [True, True, False, True, True, False]


def test_rules():
    assert state.parse_rules("60/1, 200/5") == ((60, 1), (200, 5))
    with pytest.raises(ValueError):
        state.parse_rules("10/6")


def test_keywords(spark):
    header = "\t".join(keywords.COLUMNS)
    line = "1\tshoes\t2024\t1\t10x\t60+\t\t5\t-2\tu\tv\t\t"
    rows = keywords.parse(spark.createDataFrame([(line,), (header,), ("short\tline",), ("\t" * 12,)], "value string")).collect()
    assert [r.keyword for r in rows] == ["shoes", "keyword"]  # the reader leaves out the first line, and only that
    assert (rows[0].keyword, rows[0].volume_google, rows[0].position_google, rows[0].position_seznam, rows[0].change_seznam) == ("shoes", 10, None, 5, -2)


def test_llm_answers(spark):
    raws = ['```json\n{"title":"T"}\n```', "[1]", "null", "{bad", '{"title": 5, "description": "D"}']
    got = llm_text.parse_responses(spark.createDataFrame([(r,) for r in raws], "raw string"), "raw").collect()
    assert [(r.title, r.description, r.is_object) for r in got] == [("T", None, True), (None, None, False), (None, None, False), (None, None, False), (None, "D", True)]


PAGE = """<html><head><title> A
 b </title><meta name="Description" content="d1"><meta name="description" content="d2"><meta property="og:title" content="o">
<meta http-equiv="refresh" content="5"><meta name="pagemap-x" content="1"><meta name="ai-topic" content="q">
<link rel="canonical" href="/c"><link rel="shortcut icon" href="/i"><link rel="stylesheet" href="/1.css"><link rel="stylesheet" href="/2.css">
<link rel="alternate" hreflang="cs" href="/cs"><script type="application/ld+json">{"@type":"Article"}</script>
<script type="application/ld+json">{bad</script></head><body><h1>Head <b>one</b></h1><main id="main">""" + "word " * 30 + """</main>
<div itemscope itemtype="http://s/P"><span itemprop="name">N</span><meta itemprop="price" content="5"></div>
<picture><source srcset="s.webp" type="image/webp"><img src="p.png" class="x y" alt="z"></picture>
<a href="../k" title="t"> Go <i>on</i></a><script>var hidden = 1;</script><p data-nosnippet>end</p></body></html>"""


def test_page_record():
    r = html.extract(PAGE, "https://e.com/a/b")
    assert r["title"] == "A b"
    assert r["meta"]["description"] == "d2"
    assert r["meta"]["og:title"] == "o"
    assert r["http_equiv"] == {"refresh": "5"}
    assert r["canonical"] == "/c"
    assert "shortcut icon" not in r["single_rels"]
    assert r["multi_rels"] == {"stylesheet": ["/1.css", "/2.css"]}
    assert r["alternate"][0]["hreflang"] == "cs"
    assert r["json_ld"] == ['{"@type":"Article"}']
    assert r["microdata"] == [{"types": ["http://s/P"], "properties": {"name": ["N"], "price": ["5"]}}]
    assert r["page_map"] == {"x": "1"}
    assert r["custom"] == {"ai-topic": "q"}
    assert r["headings"] == [{"level": 1, "text": "Head one"}]
    assert (r["words"], r["reading_time"]) == (37, "1 min")  # text of scripts in the body counts
    assert r["links"] == [{"raw": "../k", "href": "https://e.com/k", "rel": "", "link_title": "t", "text": "Go on"}]
    assert r["images"][0]["class_list"] == ["x", "y"]
    assert r["images"][0]["sources"] == [{"srcset": "s.webp", "media": None, "type": "image/webp"}]
    assert r["no_snippet"]
    assert "hidden" not in r["full_text"]
    assert r["main_selector"] == "main"


@pytest.mark.parametrize("page", [None, "", "<", "plain", "<p>a<p>b</div></span>"])
def test_page_record_of_odd_pages(page):
    assert html.extract(page, None)["links"] == []


def test_all_referrers_and_duplicates_are_given(spark):
    p = pages(spark, [("a", "A", 404), ("b", "B", 404), ("c", "T", 200), ("d", "T", 200), ("e", "T", 200), ("f", "", 200)])
    e = edges(spark, [(x, 0, "a", "") for x in "acde"])
    got = sorted((r.url, r.referrer or "") for r in links.referrers(e, p).collect())
    assert got == [("a", "c"), ("a", "d"), ("a", "e"), ("b", "")]
    assert sorted(issues.duplicates(p, "title").collect()) == [("T", "c"), ("T", "d"), ("T", "e")]


def test_page_record_fields():
    """Every field against what the page says, with the names that are kept and those that are not."""
    kept = ("publisher", "edit", "sidebar", "webmention", "micropub", "hub", "self", "service", "profile", "apple-touch-icon-precomposed")
    dropped = ("nofollow", "me", "mask-icon", "modulepreload", "shortcut", "terms-of-service")
    head = "".join(f'<link rel="{rel.upper()}" href="/{rel}">' for rel in kept + dropped)
    metas = {"department": "D", "tags": "a, b", "rating": "4.5 of 5", "boost": "0", "wordCount": "9", "region": "r", "search-x": "s", "AI-y": "y", "language": "cs", "editor": ""}
    head += "".join(f'<meta name="{k}" content="{v}">' for k, v in metas.items())
    body = '<article class="post">' + "<p>short</p></article>" + '<div id="content">' + "<b>x</b>" * 20 + "</div>"
    items = """<div itemscope itemtype="A B"><i itemprop="n"></i><i itemprop="n">one</i><i itemprop="n">two</i><a itemprop="u" href="/p">t</a>
<time itemprop="w">now</time><div itemscope><span itemprop="n">inner</span></div></div>"""
    r = html.extract(f"<html><head>{head}</head><body data-nosnippet>{body}{items}<h2> A </h2><script>var words;</script></body></html>", "https://e.com/x/y")
    assert set(r["single_rels"]) == set(kept)
    assert r["custom"] == {"department": "D", "search-x": "s", "ai-y": "y", "language": "cs"}
    assert (r["tags"], r["rating"], r["boost"]) == (["a", "b"], 4.5, None)
    assert (r["main_selector"], r["main_html"]) == ("#content", "<b>x</b>" * 20)  # the article's HTML is too short
    assert r["microdata"][0] == {"types": ["A", "B"], "properties": {"n": ["one", "two", "inner"], "u": ["https://e.com/p"], "w": ["now"]}}
    assert r["microdata"][1] == {"types": [], "properties": {"n": ["inner"]}}
    assert not r["no_snippet"]  # the body itself does not count
    assert r["words"] == 5 and r["headings"] == [{"level": 2, "text": "A"}]


def test_main_content_falls_back_to_the_body():
    r = html.extract("<html><body><main>tiny</main> rest</body></html>", None)
    assert (r["main_selector"], r["main_html"]) == ("body", "<main>tiny</main> rest")


def test_unclosed_elements_take_no_square_time():
    began = time.perf_counter()
    links_ = html.extract("<a href=/x>y" * 20_000, "https://e.com/")["links"]
    assert len(links_) == 20_000 and links_[0]["text"] == "y"
    html.extract("<div>" * 20_000 + "</p>" * 20_000, None)
    assert time.perf_counter() - began < 20


def test_h1_rules(spark):
    rows = [("a", []), ("b", ["Long enough one", "tiny"]), ("c", ["Long enough one"]), ("d", ["x" * 71]), ("e", None)]
    got = sorted((r.url, r.issue, r.h1 or "", r.others) for r in issues.h1_issues(spark.createDataFrame(rows, "url string, h1s array<string>")).collect())
    assert got == [
        ("a", "missing", "", None), ("b", "duplicate", "Long enough one", 1), ("b", "multiple", "", None), ("b", "too_short", "tiny", None),
        ("c", "duplicate", "Long enough one", 1), ("d", "too_long", "x" * 71, None), ("e", "missing", "", None),
    ]


def test_types_at_any_depth(spark):
    blocks = ['[{"@type":"A","@graph":[{"@type":["B","C"]},[{"@type":"B"}]]}]', "{bad", '{"x":{"@type":"not looked at"}}', "5"]
    df = spark.createDataFrame([("u", blocks), ("v", [])], "url string, blocks array<string>")
    assert [tuple(r) for r in audit.type_occurrences(df).collect()] == [("B", 2), ("A", 1), ("C", 1)]
    assert {r.url: r.issue for r in audit.jsonld_issues(df).collect()} == {"v": "missing"}
    plan = audit.type_occurrences(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_types(spark):
    deep = "[" * 900 + '{"@type":"D"}' + "]" * 900
    blocks = [
        [deep], ['{"@type":"A","@type":"B"}'], ['{"@type":["A",null,5,{"x":1}]}'], ['{"@type":""}', '{"@type":0}', '{"@type":false}', '{"@type":null}'],
        ['{"@type":true}', '{"@type":7}'], ['{"@graph":{"@type":"not a list"}}'], [None, ""], None, ['{"@type":[]}'], ["[" * 5000],
    ]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(blocks)], "k int, blocks array<string>")
    got = {r.k: r.types for r in df.select("k", audit.all_types(F.col("blocks")).alias("types")).collect()}
    assert got == {0: ["D"], 1: ["B"], 2: ["A", "null", "5", '{"x":1}'], 3: [], 4: ["true", "7"], 5: [], 6: [], 7: [], 8: [], 9: []}


def test_rotations_and_buckets(spark):
    def at(k, s):
        return datetime(2024, 1, 1, 0, k, s)

    rows = [("d", at(0, s), s, 403) for s in range(3)] + [("d", at(0, 10 + s), 10 + s, 403) for s in range(3)] + [("d", at(1, 30), 40, 403), ("d", at(1, 31), 41, 404), ("d", at(1, 32), 42, 403)]
    want = [(1, False), (2, False), (3, True), (1, False), (2, False), (3, False), (4, True), (0, False), (1, False)]
    for domain in ("d", None):
        told = [(domain, *r[1:]) for r in rows]
        got = state.rotations(spark.createDataFrame(told, "domain string, ts timestamp, seq int, status int")).orderBy("ms").collect()
        assert [(r.failures, r.is_rotated) for r in got] == want
    # the same, told by error messages
    errors = [(d, ts, seq, None if status == 403 else status, "net: blocked" if status == 403 else None) for d, ts, seq, status in rows]
    got = state.rotations(spark.createDataFrame(errors, "domain string, ts timestamp, seq int, status int, error string")).orderBy("ms").collect()
    assert [(r.failures, r.is_rotated) for r in got] == want
    hits = [("email-send", key, at(0, s), s) for s, key in enumerate(["A@x.cz", "a@X.cz"] * 4)] + [("crawl-start", "ip", at(0, s), 50 + s) for s in range(6)]
    told = state.bucket_limiter(spark.createDataFrame(hits, "bucket string, key string, ts timestamp, seq int")).orderBy("seq").collect()
    assert [r.is_admitted for r in told] == [True] * 5 + [False] * 3 + [True] * 5 + [False]


def test_even_delay_and_presets():
    assert state.even_delay_ms(state.parse_rules("tiered")) == 36_000
    assert state.even_delay_ms(((100, 1),), 0.8) == 28_800
    assert state.parse_rules("bulk") == ((1000, 5),)


def test_referrer_rows_feed_the_reports(spark, tmp_path):
    p = pages(spark, [("https://e/a", "A", 404), ("https://e/b", "B", 404), ("https://e/c", "C", 200)])
    e = edges(spark, [(f"https://e/{x}", 0, "https://e/a", "") for x in "cdf"])
    sinks.not_found_csv(links.referrers(e, p), f"{tmp_path}/404")
    back = sorted((r.url, r.referrer or "", r.origin) for r in spark.read.csv(f"{tmp_path}/404", header=True).collect())
    assert back == [("https://e/a", f"https://e/{x}", "linked") for x in "cdf"] + [("https://e/b", "", "seeded_or_sitemap")]
    assert [r.sample for r in links.not_found_report(e, p).orderBy("url").collect()] == [["https://e/c", "https://e/d", "https://e/f"], None]
    refs = probes.target_rows(("internal-link", e.select("src_url", F.col("href").alias("url"))))
    found = probes.broken(probes.targets(("internal-link", e.select("src_url", F.col("href").alias("url")))), spark.createDataFrame([("https://e/a", None)], "url string, status int"), "e")
    sinks.broken_csv(found, refs, f"{tmp_path}/broken")
    assert {(r.status, r.kind) for r in spark.read.csv(f"{tmp_path}/broken", header=True).collect()} == {("ERR", "internal-link")}


def test_hot_groups_join_apart(spark, monkeypatch):
    monkeypatch.setattr(groups, "SALTS", 3)
    rows = spark.createDataFrame([(k % 7, k) for k in range(50)] + [(1, k) for k in range(100)], "v int, k int")
    sizes = rows.groupBy("v").agg(F.count("*").alias("n")).where("v <> 3")
    for how in ("inner", "left"):
        got = groups.join_groups(rows, sizes, "v", how).collect()
        assert sorted(map(str, got)) == sorted(map(str, rows.join(sizes, "v", how).collect()))


def test_html_links_are_resolved_and_of_the_same_domain(spark):
    page = """<a href="/a"><a HREF='b.html'><a href="../c"><a href="?p=2"><a href="https://e.com/d"><a href='https://sub.e.com/e'>
<a href="//other.example/x"><a href="https://note.com/y"><a href="#f"><a href="mailto:m@e.com"><a href="javascript:v()">
<a href="tel:1"><a href="/sitemap.xml"><a href="/a">"""
    df = spark.createDataFrame([("https://e.com/k/l", page)], "url string, html string")
    expected = ["https://e.com/" + x for x in ("a", "c", "d", "k/b.html", "k/l?p=2")] + ["https://sub.e.com/e"]
    assert sorted(r.url for r in sitemaps.html_links(df).collect()) == sorted(expected)
