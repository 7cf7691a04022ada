from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitelume.functions import text as t
from sitelume.functions import urls, weburl


def values(spark, rows, expr):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("x"))).collect()]


def test_pixel_width(spark):
    assert values(spark, ["WM", "W" * 35, "", None, "é", "a b"], t.pixel_width) == [32, 595, 0, None, 8, 23]


def test_js_length(spark):
    assert values(spark, ["😀a", ""], t.js_length) == [3, 0]


def test_redaction(spark):
    got = values(spark, ["mail a.b@c.io or +420 123 456 789", "call 555-1234", "plain"], t.redact)
    assert got == ["mail [REDACTED_EMAIL] or [REDACTED_PHONE]", "call [REDACTED_PHONE]", "plain"]


def test_int_prefix(spark):
    assert values(spark, ["12abc", " -3", "60+", "", "x", None], t.int_prefix) == [12, -3, 60, None, None, None]


def test_body_text(spark):
    page = "<html><head><title>T</title></head><body><p>a</p><script>var x='</p>'</script>\n b&amp;</body>"
    assert values(spark, [page, "", None], t.body_text) == ["a b&amp;", "", None]


def test_clip_and_entities(spark):
    assert values(spark, ["abcd", "abc"], lambda c: t.clip(c, 3)) == ["abc…", "abc"]
    assert values(spark, ["&lt;a&gt; &#39;x&#039;&nbsp;&quot;"], t.decode_entities) == ["<a> 'x' \""]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://example.com", True),
        ("https://example.com/", True),
        ("https://example.com/#", True),
        ("https://example.com/.", True),
        ("https://EXAMPLE.com:443/", True),
        ("https://example.com/?x", False),
        ("https://example.com/#s", False),
        ("https://example.com/a", False),
        ("ftp://example.com/", False),
        ("not a url", False),
    ],
)
def test_homepage(spark, url, expected):
    assert values(spark, [url], urls.is_homepage) == [expected]


def test_categorize(spark):
    rows = ["https://www.example.com/a", "https://blog.example.com", "ftp://example.com/f", "mailto:a@b.cz", "tel:+1", "/rel", "https://notexample.com", "https://x.cz"]
    got = values(spark, rows, lambda c: urls.categorize(c, ["example.com"]))
    assert got == ["internal", "internal", "internal", "external", "external", "internal", "external", "external"]
    got = values(spark, rows[:2], lambda c: urls.categorize(c, ["example.com"], ["blog.example.com"], ["/a"]))
    assert got == ["external", "external"]


def test_private_addresses(spark):
    rows = ["10.1.2.3", "172.31.0.1", "172.32.0.1", "8.8.8.8", "100.64.0.1", "::1", "fc00::1", "fe80::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "2001:db8::1"]
    assert values(spark, rows, urls.private_ip) == [True, True, False, False, True, True, True, True, True, False, False]


def test_verdicts(spark):
    rows = ["x", "ftp://a.b/", "http://127.0.0.1/x", "https://example.com/", "http://localhost/", "http://[::1]/", "http://2130706433/", "http://8.8.8.8/", "https://no.example/", None]
    dns = spark.createDataFrame([("localhost", "127.0.0.1"), ("example.com", "93.184.216.34")], "host string, address string")
    told = urls.request_verdicts(spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, url string"), dns)
    private = "Target resolves to a private address"
    assert [r.verdict for r in told.orderBy("k").collect()] == [
        "Invalid URL format", "Only http(s) URLs are allowed", private, None, private, private, private, None,
        "Cannot resolve hostname: no.example", "Invalid URL format",
    ]


@pytest.mark.parametrize(
    ("raw", "base", "href"),
    [
        ("HTTP://EXAMPLE.com:80/a/../b?x#y", None, "http://example.com/b?x#y"),
        ("https://ex\u00e4mple.com", None, "https://xn--exmple-cua.com/"),
        ("../x", "https://a.com/b/c/d", "https://a.com/b/x"),
        ("?p=2", "https://e.com/k/l?q#f", "https://e.com/k/l?p=2"),
        ("//o.example/x", "https://e.com/k", "https://o.example/x"),
        ("", "https://e.com/k/l?q=1", "https://e.com/k/l?q=1"),
        ("http:\\\\x.com\\y", None, "http://x.com/y"),
        ("http://u:p@h.com/", None, "http://h.com/"),
        ("https://e.com/%2e%2E/x/./y/..", None, "https://e.com/x/"),
        ("http://0x7f.1/", None, "http://127.0.0.1/"),
        ("http://[FD00::1]:8080/x", None, "http://[fd00::1]:8080/x"),
        ("mailto:a@b.c", None, "mailto:a@b.c"),
        ("not a url", None, None),
        ("http://exa mple.com/", None, None),
        ("http://[bad", None, None),
        ("https://", None, None),
        ("http://a.com:99999/", None, None),
        ("http://1.2.3.4.5/", None, None),
        (None, None, None),
    ],
)
def test_parse(raw, base, href):
    found = weburl.parse(raw, base)
    assert (found.href if found else None) == href


def test_sql_and_python_parse_alike(spark):
    rows = ["https://e.com/a/b.html?x=1&y=2#z", "https://e.com/a/../b", "https://e.com/a/.", "https://www.e-f.com/", "https://e.com/a//b", "https://e.com/.hidden", "https://e.com/a..b/", "http://e.com/%2e/x", "https://e.com/..", "https://1.2.3.4/", "https://e.com"]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    got = [tuple(r[0]) for r in df.orderBy("k").select(urls.parts(F.col("x"))).collect()]
    assert got == [tuple(weburl.parse(r)) for r in rows]


def test_normalize_drops_fragments_and_other_schemes(spark):
    df = spark.createDataFrame([("/a#b",), ("mailto:x@y.z",), ("https://e.com/#",), ("http://[x",)], "x string")
    got = [r[0] for r in df.select(urls.normalize(F.col("x"), F.lit("https://e.com/k"))).collect()]
    assert got == ["https://e.com/a", None, "https://e.com/", None]


def test_small_texts(spark):
    assert values(spark, ["https://e.com/a_(b)|c", "javascript:x"], t.markdown_link) == ["[https://e.com/a\\_\\(b\\)\\|c](https://e.com/a\\_\\(b\\)\\|c)", "javascript:x"]
    assert values(spark, ["P\u0159\u00edli\u0161 \u017elu\u0165ou\u010dk\u00fd K\u016f\u0148!", "A  b"], t.slug) == ["prilis-zlutoucky-kun", "a-b"]
    assert values(spark, ["a@b.cz", "a b@c.cz", "x"], t.is_email) == [True, False, False]
    assert values(spark, ["https://u:p@h.cz/x"], t.hide_credentials) == ["//h.cz/x".join(["https:", ""])]
    assert values(spark, ["", "x"], t.or_none) == [None, "x"]
    assert values(spark, ["1.1.1.1, 2.2.2.2 ", "3.3.3.3,", ""], urls.x_forwarded_last) == ["2.2.2.2", "3.3.3.3", None]
    assert values(spark, ["https://www.e.com/x", "nothing"], urls.storage_domain) == ["e.com", "default"]
    assert values(spark, ["https://e.com/a?b", "https://e.com"], urls.short) == ["/a?b", "/"]
