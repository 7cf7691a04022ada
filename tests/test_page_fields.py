"""Every field of a page record against the tree that the page was written from."""

from __future__ import annotations

import json
import random
import re
from html import escape

import pandas as pd
import pytest

from sitelume.operators import html

VOID = {"meta", "link", "img", "source", "br"}
WORDS = ["one", "two", "Ž lut", "a & b", "<", "'q'", "5", "\n", "x" * 40, "  "]
URL = "https://e.com/dir/page"
NAMES = ["description", "Description", "og:title", "tags", "rating", "boost", "category", "ai-topic", "search-x", "pagemap-k", "author"]
RELS = ["canonical", "next", "icon", "Author", "stylesheet", "preload", "alternate", "shortcut icon", "tag"]
BLOCKS = {"p", "div", "li", "br", "section", "article", "ul", "h1", "h2", "h3"}


def node(tag, children=(), **attrs):
    return tag, {k.rstrip("_").replace("_", "-"): v for k, v in attrs.items() if v is not None}, list(children)


def render(x) -> str:
    if isinstance(x, str):
        return escape(x, quote=False)
    tag, attrs, children = x
    head = f"<{tag}" + "".join(f' {k}="{escape(v)}"' for k, v in attrs.items()) + ">"
    return head if tag in VOID else head + "".join(c if tag == "script" else render(c) for c in children) + f"</{tag}>"


def walk(x, parents=()):
    if not isinstance(x, str):
        yield x, parents
        for c in x[2]:
            yield from walk(c, (*parents, x))


def text(x) -> str:
    return x if isinstance(x, str) else "".join(map(text, x[2]))


def seen(x) -> str:
    """Text as it is shown: blocks part words, scripts are left out."""
    if isinstance(x, str):
        return x
    inner = "" if x[0] in ("script", "style", "noscript") else "".join(map(seen, x[2]))
    return f" {inner} " if x[0] in BLOCKS else inner


def make(r: random.Random):
    def some(f, most):
        return [f() for _ in range(r.randint(0, most))]

    def maybe(*values):
        return r.choice([None, *values])

    def inline():
        kind = r.randint(0, 7)
        if kind == 0:
            return node("span", words(), itemprop=maybe("name", "price"), data_nosnippet=maybe(*[""] * (r.random() < 0.02)))
        if kind == 1:
            image = node("img", src=maybe("p.png", "/q.png"), alt=maybe("z"), width=maybe("5"), class_=maybe("a b"), itemprop=maybe("image"), loading=maybe("lazy"))
            return node("picture", [*some(lambda: node("source", srcset=maybe("s.webp"), media=maybe("print"), type=maybe("image/webp")), 2), image])
        if kind == 2:
            return node("a", words(), href=maybe("../k", "https://o.org/ x", "#f", "http://[bad", "mailto:a@b"), rel=maybe("nofollow"), title=maybe("t"), itemprop=maybe("url"))
        if kind == 3:
            return node("time", words(), datetime=maybe("2024-01-01"), itemprop=maybe("date"))
        if kind == 4:
            return node("meta", itemprop=maybe("price"), content=maybe("7"))
        return r.choice(WORDS)

    def words():
        return some(lambda: r.choice(WORDS), 3)

    def block(depth=0):
        kind = r.randint(0, 6)
        if kind < 3 and depth < 4:
            scope = {"itemscope": "", "itemtype": maybe("http://s/P http://s/Q"), "itemprop": maybe("part")} if r.random() < 0.3 else {}
            tag = r.choice(["div", "section", "article", "main"])
            return node(tag, some(lambda: block(depth + 1), 4), id=maybe("content", "o"), class_=maybe("main x", "article"), role=maybe("main"), **scope)
        if kind == 3:
            return node("ul", some(lambda: node("li", some(inline, 3)), 3))
        if kind == 4:
            return node(r.choice(["h1", "h2", "h3"]), some(lambda: r.choice(WORDS), 3))
        if kind == 5:
            return node("script", [r.choice(['{"@type":"A"}', "{bad", "[]", "0", "null", '"x"', "var k = 1;"])], type=maybe("application/ld+json"))
        return node("p", some(inline, 5))

    def head():
        kind = r.randint(0, 2)
        if kind == 0:
            return node("meta", name=maybe(*NAMES), property=maybe("og:title", "article:tag"), http_equiv=maybe("Refresh"), content=maybe("", "a, b", "4.5x", "0", "q"))
        if kind == 1:
            return node("link", rel=maybe(*RELS), href=maybe("/1", "/2"), hreflang=maybe("cs"), media=maybe("print"), type=maybe("text/css"))
        return node("title", [" ".join(words())])

    return node("html", [node("head", some(head, 8)), node("body", some(block, 6))])


def absolute(raw: str) -> str:
    return {"../k": "https://e.com/k", "https://o.org/ x": "https://o.org/%20x", "#f": URL + "#f", "p.png": "https://e.com/dir/p.png", "/q.png": "https://e.com/q.png", "": URL}.get(raw, raw)


def number(value):
    found = re.match(r"[\d.]+", value or "")
    return float(found[0]) or None if found else None


def value_of(x) -> str:
    tag, a, _ = x
    if tag == "meta":
        return a.get("content", "")
    if tag == "img":
        return absolute(a.get("src", ""))
    if tag == "a":
        return absolute(a["href"]) if "href" in a else ""
    if tag == "time":
        return a.get("datetime") or text(x)
    return text(x).strip()


def expected(page) -> dict:
    everything = list(walk(page))
    of = lambda *tags: [(x, up) for x, up in everything if x[0] in tags]
    body = page[2][1]
    meta, equiv, custom, page_map, single, multi, alternate = {}, {}, {}, {}, {}, {}, []
    for (_, a, _), _ in of("meta"):
        name, prop, content = a.get("name", "").lower(), a.get("property", ""), a.get("content", "")
        if name or prop:
            meta[name or prop] = content
        elif "http-equiv" in a:
            equiv[a["http-equiv"].lower()] = content
        if content and ((name or prop) in html.CUSTOM_NAMES or (name or prop).startswith(("ai-", "search-"))):
            custom[name or prop] = content
        if content and name.startswith("pagemap-"):
            page_map[name[8:]] = content
    # rating, boost and tags are custom names too
    for (_, a, _), _ in of("link"):
        rel, href = a.get("rel", "").lower(), a.get("href")
        if rel == "alternate" and href:
            alternate.append({k: a.get(k) for k in ("href", "hreflang", "media", "type")})
        elif rel in ("stylesheet", "preload", "tag") and href:
            multi.setdefault(rel, []).append(href)
        elif rel in ("canonical", "next", "icon", "author") and href:
            single[rel] = href
    items = []
    for scope, _ in everything:
        if "itemscope" in scope[1]:
            found = {}
            for x, _ in list(walk(scope))[1:]:
                if "itemprop" in x[1]:
                    old = found.get(x[1]["itemprop"], [])
                    found[x[1]["itemprop"]] = [*([] if old == [""] else old), value_of(x)]
            items.append({"types": scope[1].get("itemtype", "").split(), "properties": found})
    images = []
    for (_, a, _), up in of("img"):
        sources = [{"srcset": s[1].get("srcset", ""), "media": s[1].get("media"), "type": s[1].get("type")} for s in up[-1][2] if s[0] == "source"]
        images.append({k: a.get(k, "") for k in ("src", "alt", "title", "width", "height", "srcset", "loading")} | {"class_list": a.get("class", "").split(), "sources": sources})
    blocks = []
    for x, _ in of("script"):
        if x[1].get("type") == "application/ld+json":
            try:
                told = json.loads(x[2][0])
            except ValueError:
                continue
            if told or told == []:
                blocks.append(x[2][0])
    inner = lambda x: "".join(map(render, x[2]))
    tests = {
        "main": lambda t, a: t == "main", "article": lambda t, a: t == "article", '[role="main"]': lambda t, a: a.get("role") == "main",
        "#content": lambda t, a: a.get("id") == "content", ".main": lambda t, a: "main" in a.get("class", "").split(),
        ".article": lambda t, a: "article" in a.get("class", "").split(),
    }
    main = {"main_selector": "body", "main_html": inner(body)}
    for place in html.MAIN_PLACES:
        first = next((x for x, _ in everything if place in tests and tests[place](x[0], x[1])), None)
        if first and len(inner(first).strip()) > 100:
            main = {"main_selector": place, "main_html": inner(first)}
            break
    titles = of("title")
    words = len(text(body).split()) or 1
    return main | {
        "url": URL, "title": " ".join(text(titles[0][0]).split()) if titles else "", "meta": meta, "http_equiv": equiv, "canonical": single.get("canonical"),
        "alternate": alternate, "single_rels": single, "multi_rels": multi, "no_snippet": any("data-nosnippet" in x[1] for x, _ in list(walk(body))[1:]),
        "json_ld": blocks, "microdata": items, "custom": {k: v for k, v in custom.items() if k not in ("tags", "rating", "boost")},
        "tags": [t.strip() for t in custom["tags"].split(",")] if "tags" in custom else None, "rating": number(custom.get("rating")),
        "boost": number(custom.get("boost")), "page_map": page_map, "words": words, "reading_time": f"{(words + 199) // 200} min",
        "headings": [{"level": int(x[0][1]), "text": text(x).strip()} for x, _ in of("h1", "h2", "h3")],
        "links": [{"raw": x[1]["href"], "href": absolute(x[1]["href"]), "rel": x[1].get("rel", ""), "link_title": x[1].get("title", ""), "text": text(x).strip()}
                  for x, _ in of("a") if "href" in x[1]],
        "images": images, "full_text": " ".join(seen(body).split()), "full_html": render(page),
    }


@pytest.mark.parametrize("seed", range(8))
def test_every_field(seed):
    r = random.Random(seed)
    for _ in range(150):
        page = make(r)
        want, got = expected(page), html.extract(render(page), URL)
        assert set(got) == set(html.FIELDS) == set(want)
        for field in html.FIELDS:
            assert got[field] == want[field], (field, render(page))


def test_a_field_alone_is_as_in_the_whole_record():
    r = random.Random(99)
    for _ in range(40):
        page = render(make(r))
        whole = html.extract(page, URL)
        for field in html.FIELDS:
            assert html.extract(page, URL, frozenset({field}))[field] == whole[field], (field, page)


def test_open_elements_end_with_the_page():
    got = html.extract("<main>" + "word " * 30 + "<script>never closed", URL)
    assert got["main_selector"] == "main" and got["main_html"].endswith("never closed")


def test_nesting_beyond_any_use_is_left_out():
    page = f'<script type="application/ld+json">{"[" * 200_000}</script><a href="/k">k</a>'
    got = html.extract(page, URL)
    assert got["json_ld"] == [] and len(got["links"]) == 1


def test_table_functions(spark):
    pages = [(1, '<a href="/k" rel="r">K <b>k</b></a><a href="#">x</a><img src="i.png" class="c d">'), (2, "no tags"), (3, None)]
    spark.createDataFrame(pages, "id int, html string").createOrReplaceTempView("some_pages")
    html.register(spark)
    found = spark.sql("SELECT id, a.* FROM some_pages, LATERAL anchors(html, 'https://e.com/d') a ORDER BY id, pos").collect()
    assert [tuple(r) for r in found] == [(1, 0, "K k", "https://e.com/k", "/k", "r", ""), (1, 1, "x", "https://e.com/d#", "#", "", "")]
    found = spark.sql("SELECT id, i.src, i.class_list FROM some_pages, LATERAL images(html) i ORDER BY id").collect()
    assert [tuple(r) for r in found] == [(1, "i.png", ["c", "d"])]


def test_records_are_handed_on_by_parts():
    """A task holds the records of a few MB of HTML, however many rows a batch has."""

    class Pages:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            return run

    sizes = [0, 10, html.PART_CHARS + 1, 5, html.PART_CHARS // 2, html.PART_CHARS // 2, 7, 0]
    pages = ["<title>t</title>" + "x" * n for n in sizes] + [None]
    batch = pd.DataFrame({"url": [str(n) for n in range(len(pages))], "html": pages})
    parts = list(html.page_records(Pages(), ("url", "words"))(iter([batch])))
    assert [u for part in parts for u in part["url"]] == list(batch["url"])
    assert len(parts) >= 3
    assert all(sum(len(pages[int(u)] or "") for u in part["url"][1:]) <= html.PART_CHARS for part in parts)
