"""One parse of a page's HTML into one record."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelume.functions import weburl

# Link relations that keep all their URLs.
MULTI_RELS = ("dns-prefetch", "preconnect", "prefetch", "preload", "prerender", "stylesheet", "tag")
# Link relations that keep their last URL.
SINGLE_RELS = (
    "canonical", "prev", "next", "amphtml", "manifest", "icon", "apple-touch-icon", "apple-touch-icon-precomposed",
    "shortlink", "publisher", "author", "search", "edit", "help", "license", "bookmark", "up", "first", "last", "sidebar",
    "pingback", "webmention", "micropub", "hub", "self", "service", "profile",
)
# Names of custom metadata. Names of pages are lower-cased before they are looked up here.
CUSTOM_NAMES = (
    "department", "category", "section", "tags", "rating", "difficulty", "audience", "language", "datePublished",
    "dateModified", "dateCreated", "lastReviewed", "expiryDate", "author", "contributor", "publisher", "editor",
    "readingTime", "wordCount", "pageViews", "contentType", "priority", "boost",
)
# Places of the main content, in the order they are tried, and the characters of HTML it must exceed.
MAIN_PLACES = (
    "main", "article", '[role="main"]', "#content", ".content", "#main-content", ".main-content", ".article",
    ".page-content", "#main", ".main", ".entry-content", ".post-content",
)
MAIN_CHARS, WORDS_PER_MINUTE = 100, 200
# Names of entities that browsers decode without their semicolon too. Where they are to stay, a noncharacter
# stands for their sign while the page is read, so that places and lengths are those of the page.
_NAMES, _MARK = "(?:copy|middot|quot)", "\ufdd0"
_BARE, _MARKED = re.compile(f"&(?={_NAMES}(?!;))"), re.compile(f"{_MARK}(?={_NAMES})")
#: Characters of HTML, and of what any page takes besides, that are parsed before their records are handed on.
PART_CHARS, PAGE_CHARS = 1 << 22, 256

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HEAD_TAGS = {"html", "head", "title", "meta", "link", "script", "style", "base", "noscript", "template"}
BLOCKS = {"p", "div", "li", "br", "tr", "section", "article", "ul", "ol", "table", *HEADINGS}
#: An opening tag ends an open element of these, as elements of its kind do not nest.
CLOSES = {"a": {"a"}, "li": {"li"}, "option": {"option"}} | {h: HEADINGS | {"p"} for h in HEADINGS} | {
    b: {"p"} for b in ("p", "div", "ul", "ol", "table", "section", "article")
}

FIELDS = {
    "url": "string",
    "title": "string",
    "meta": "map<string,string>",
    "http_equiv": "map<string,string>",
    "canonical": "string",
    "alternate": "array<struct<href:string,hreflang:string,media:string,type:string>>",
    "single_rels": "map<string,string>",
    "multi_rels": "map<string,array<string>>",
    "no_snippet": "boolean",
    "json_ld": "array<string>",
    "microdata": "array<struct<types:array<string>,properties:map<string,array<string>>>>",
    "custom": "map<string,string>",
    "tags": "array<string>",
    "rating": "double",
    "boost": "double",
    "page_map": "map<string,string>",
    "words": "long",
    "reading_time": "string",
    "headings": "array<struct<level:int,text:string>>",
    "links": "array<struct<text:string,href:string,raw:string,rel:string,link_title:string>>",
    "images": "array<struct<src:string,alt:string,title:string,width:string,height:string,srcset:string,loading:string,"
    "class_list:array<string>,sources:array<struct<srcset:string,media:string,type:string>>>>",
    "full_text": "string",
    "full_html": "string",
    "main_html": "string",
    "main_selector": "string",
}


#: What reads the tags that only these fields need.
READERS = {
    "title": {"title"}, "a": {"links"}, "img": {"images"}, "picture": {"images"}, "source": {"images"}, "script": {"json_ld"},
    "link": {"canonical", "alternate", "single_rels", "multi_rels"},
    "meta": {"meta", "http_equiv", "custom", "tags", "rating", "boost", "page_map"},
} | {h: {"headings"} for h in HEADINGS}


class _Page(HTMLParser):
    """Collects what the wanted fields need while it reads, in time that grows with the page.

    Text is kept once, in order; an element that wants its text remembers where
    it began.
    """

    def __init__(self, url: str | None, html: str, wanted: frozenset[str] = frozenset(FIELDS), bare_names: bool = True):
        super().__init__(convert_charrefs=True)
        self.url, self.html = url, html
        self.source, self.marks = (html, 0) if bare_names else _BARE.subn(_MARK, html)
        self.reads = {tag for tag, fields in READERS.items() if fields & wanted}
        self.wants_items, self.wants_text = "microdata" in wanted, "full_text" in wanted
        self.places = frozenset(MAIN_PLACES if wanted & {"main_html", "main_selector"} else ())
        self.at = 0
        self.meta: dict[str, str] = {}
        self.http_equiv: dict[str, str] = {}
        self.named: list[tuple[str, str]] = []  # (key, content) of meta tags, for custom metadata
        self.page_map: dict[str, str] = {}
        self.alternate: list[dict] = []
        self.single: dict[str, str] = {}
        self.multi: dict[str, list[str]] = {}
        self.json_ld: list[str] = []
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.headings: list[dict] = []
        self.items: list[dict] = []
        self.main: dict[str, tuple[int, int]] = {}
        self.body: list[int | None] = [None, None]
        self.title: str | None = None
        self.no_snippet = False
        self.stack: list[tuple[str, list, bool]] = []  # tag, what to do at its end, whether it is a scope
        self.open: Counter[str] = Counter()
        self.scopes: list[dict] = []
        self.pictures: list[list[dict]] = []
        self.chunks: list[str] = []  # all text
        self.body_from: int | None = None
        self.visible: list[str] = []
        self.hidden = 0

    def updatepos(self, i: int, j: int) -> int:
        """The parser tells how far it is in what it has not thrown away; lines are not counted."""
        self.at = j
        return j

    def _offset(self) -> int:
        return len(self.html) - len(self.rawdata) + self.at

    def _text(self, start: int) -> str:
        return "".join(self.chunks[start:])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v if v is not None else "" for k, v in reversed(attrs)}
        if self.marks:
            a = {k: _MARKED.sub("&", v) for k, v in a.items()}
        for other in CLOSES.get(tag, ()):
            if self.open[other] and not (tag in HEADINGS and other in HEADINGS and self.stack[-1][0] != other):
                self._end(other)
        inner = self._offset() + len(self.get_starttag_text() or "")
        if self.body_from is not None and "data-nosnippet" in a:
            self.no_snippet = True
        if tag == "body" and self.body[0] is None:
            self.body[0] = inner
        if self.body_from is None and (tag == "body" or tag not in HEAD_TAGS):
            self.body_from = len(self.chunks)
        ends: list = []
        if self.wants_items and a.get("itemprop"):
            self._property(tag, a, ends)
        if tag in self.reads and tag not in HEADINGS:
            getattr(self, f"_on_{tag}")(a, ends)
        elif tag in self.reads:
            entry, start = {"level": int(tag[1]), "text": ""}, len(self.chunks)
            self.headings.append(entry)
            ends.append(lambda _: entry.update(text=self._text(start).strip()))
        for place in self.places & _names(tag, a) - self.main.keys() if self.places else ():
            self.main[place] = (inner, inner)
            ends.append(lambda at, place=place: self.main.update({place: (inner, at)}))
        if tag in BLOCKS:
            self.visible.append(" ")
        if tag in VOID:
            for end in ends:
                end(inner)
            return
        scope = self.wants_items and "itemscope" in a
        if scope:
            item = {"types": a["itemtype"].split(" ") if "itemtype" in a else [], "found": []}
            self.items.append(item)
            self.scopes.append(item)
        self.stack.append((tag, ends, scope))
        self.open[tag] += 1
        self.hidden += tag in HIDDEN or tag in ("head", "title")

    def handle_endtag(self, tag: str) -> None:
        if tag == "body":
            self.body[1] = self._offset()
        if self.open[tag]:
            self._end(tag)
        if tag in BLOCKS:
            self.visible.append(" ")

    def _end(self, tag: str) -> None:
        """Close the innermost element of that name, and those in it that are still open."""
        at = self._offset()
        while True:
            name, ends, scope = self.stack.pop()
            self.open[name] -= 1
            self.hidden -= name in HIDDEN or name in ("head", "title")
            for end in ends:
                end(at)
            if scope:
                self.scopes.pop()
            if name == "picture" and self.pictures:
                self.pictures.pop()
            if name == tag:
                return

    def finish(self) -> None:
        """What is still open ends with the page."""
        self.at = len(self.rawdata)
        while self.stack:
            self._end(self.stack[-1][0])

    def handle_data(self, data: str) -> None:
        if self.marks:
            data = _MARKED.sub("&", data)
        self.chunks.append(data)
        if self.body_from is None and not self.hidden and data.strip():
            self.body_from = len(self.chunks) - 1
        if self.wants_text and not self.hidden:
            self.visible.append(data)

    def _property(self, tag: str, a: dict, ends: list) -> None:
        if not self.scopes:
            return
        entry = [a["itemprop"], ""]
        for item in self.scopes:
            item["found"].append(entry)
        start = len(self.chunks)
        if tag == "meta":
            entry[1] = a.get("content", "")
        elif tag == "img":
            entry[1] = self._absolute(a.get("src", ""))
        elif tag == "a":
            entry[1] = self._absolute(a["href"]) if "href" in a else ""
        elif tag == "time":
            entry[1] = a.get("datetime", "")
            if not entry[1]:
                ends.append(lambda _: entry.__setitem__(1, self._text(start)))
        else:
            ends.append(lambda _: entry.__setitem__(1, self._text(start).strip()))

    def _absolute(self, raw: str) -> str:
        found = weburl.parse(raw, self.url)
        return found.href if found else raw

    def _on_title(self, a: dict, ends: list) -> None:
        if self.title is None and not self.open["svg"]:
            start = len(self.chunks)
            ends.append(lambda _: setattr(self, "title", " ".join(self._text(start).split())))

    def _on_meta(self, a: dict, ends: list) -> None:
        name, prop, value = a.get("name", "").lower(), a.get("property", "").lower(), a.get("content", "")
        if name or prop:
            self.meta[name or prop] = value
        elif a.get("http-equiv"):
            self.http_equiv[a["http-equiv"].lower()] = value
        key = name if "name" in a else prop
        if key and value:
            self.named.append((key, value))
        if a.get("name", "").startswith("pagemap-") and value:
            self.page_map[a["name"].replace("pagemap-", "", 1)] = value

    def _on_link(self, a: dict, ends: list) -> None:
        rel, href = a.get("rel", "").lower(), a.get("href", "")
        if not rel or not href:
            return
        if rel == "alternate":
            self.alternate.append({k: a.get(k) for k in ("href", "hreflang", "media", "type")})
        elif rel in MULTI_RELS:
            self.multi.setdefault(rel, []).append(href)
        elif rel in SINGLE_RELS:
            self.single[rel] = href

    def _on_script(self, a: dict, ends: list) -> None:
        if a.get("type") == "application/ld+json":
            start = len(self.chunks)
            ends.append(lambda _: self._json(self._text(start)))

    def _json(self, raw: str) -> None:
        try:
            value = json.loads(raw)
        except (ValueError, RecursionError):  # broken, or nested beyond any use
            return
        if value or isinstance(value, (list, dict)):  # of the values that count as false, empty lists and objects stay
            self.json_ld.append(raw.strip())

    def _on_a(self, a: dict, ends: list) -> None:
        if "href" not in a:
            return
        entry = {"raw": a["href"], "href": self._absolute(a["href"]), "rel": a.get("rel", ""), "link_title": a.get("title", ""), "text": ""}
        self.links.append(entry)
        start = len(self.chunks)
        ends.append(lambda _: entry.update(text=self._text(start).strip()))

    def _on_img(self, a: dict, ends: list) -> None:
        image = {k: a.get(k, "") for k in ("src", "alt", "title", "width", "height", "srcset", "loading")}
        self.images.append(image | {"class_list": a.get("class", "").split(), "sources": self.pictures[-1] if self.pictures else []})

    def _on_picture(self, a: dict, ends: list) -> None:
        self.pictures.append([])

    def _on_source(self, a: dict, ends: list) -> None:
        for sources in self.pictures:
            sources.append({"srcset": a.get("srcset", ""), "media": a.get("media") or None, "type": a.get("type") or None})


def _names(tag: str, a: dict) -> set[str]:
    """The simple selectors that an element answers to."""
    names = {tag, "#" + a["id"]} if "id" in a else {tag}
    if a.get("role") == "main":
        names.add('[role="main"]')
    return names.union("." + c for c in a["class"].split()) if a.get("class") else names


def _properties(found: list[list[str]]) -> dict[str, list[str]]:
    """Values by name, in the order of the page; an empty first value gives way to the next."""
    out: dict[str, list[str]] = {}
    for name, value in found:
        if out.get(name) and out[name] != [""]:
            out[name].append(value)
        else:
            out[name] = [value]
    return out


def _number(text: str | None) -> float | None:
    """The number a text begins with; none for zero."""
    found = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text or "")
    return float(found[0]) or None if found else None


def extract(html: str | None, url: str | None, wanted: frozenset[str] = frozenset(FIELDS), bare_names: bool = True) -> dict:
    """The record of one page; a null or empty page has empty fields, as have those not wanted.

    HTML of the main content is cut out of the source as it is. Words are those
    of all text in the body, that of scripts included; no text is one word.
    Without `bare_names`, `&copy`, `&middot` and `&quot` are decoded with their
    semicolon only.
    """
    page = _Page(url, html or "", wanted, bare_names)
    page.feed(page.source)
    page.close()
    page.finish()
    full = " ".join("".join(page.visible).split())
    body_text = "".join(page.chunks[page.body_from :]) if page.body_from is not None else ""
    words = len(body_text.split()) or 1
    custom: dict[str, str] = {}
    for key, value in page.named:
        if key in CUSTOM_NAMES or key.startswith(("ai-", "search-")):
            custom[key] = value
    tags = custom.get("tags")
    body = page.html[page.body[0] or 0 : page.body[1]]
    selector, main = next(
        ((p, text) for p in MAIN_PLACES if p in page.main and len((text := page.html[slice(*page.main[p])]).strip()) > MAIN_CHARS),
        ("body", body),
    )
    return {
        "url": url,
        "title": page.title or "",
        "meta": page.meta,
        "http_equiv": page.http_equiv,
        "canonical": page.single.get("canonical"),
        "alternate": page.alternate,
        "single_rels": page.single,
        "multi_rels": page.multi,
        "no_snippet": page.no_snippet,
        "json_ld": page.json_ld,
        "microdata": [{"types": i["types"], "properties": _properties(i["found"])} for i in page.items],
        "custom": {k: v for k, v in custom.items() if k not in ("tags", "rating", "boost")},
        "tags": None if tags is None else [t.strip() for t in tags.split(",")],
        "rating": _number(custom.get("rating")),
        "boost": _number(custom.get("boost")),
        "page_map": page.page_map,
        "words": words,
        "reading_time": f"{-(-words // WORDS_PER_MINUTE)} min",
        "headings": page.headings,
        "links": page.links,
        "images": page.images,
        "full_text": full,
        "full_html": page.html,
        "main_html": main,
        "main_selector": selector,
    }


def _parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of a batch in order, by parts of about PART_CHARS; a longer page may stand alone."""
    end = batch["html"].map(lambda html: len(html or "") + PAGE_CHARS).cumsum()
    for _, part in batch.groupby(end // PART_CHARS):
        yield part


def page_records(pages: DataFrame, fields: tuple[str, ...] = tuple(FIELDS), bare_names: bool = True) -> DataFrame:
    """Records of `pages` (url, html), with the wanted `fields`: each page is parsed once, in Arrow batches, without a shuffle.

    Tags that no wanted field needs are passed over. A task holds the records
    of a part of a batch, not of all its rows. `bare_names` as in `extract`.
    """
    wanted = frozenset(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (part for batch in batches for part in _parts(batch)):
            rows = []
            for html, url in zip(part["html"], part["url"], strict=True):
                record = extract(html, url, wanted, bare_names)
                rows.append({name: record[name] for name in fields})
            yield pd.DataFrame(rows, columns=list(fields))

    return pages.select("url", "html").mapInPandas(run, ", ".join(f"{name} {FIELDS[name]}" for name in fields))


def link_rows(records: DataFrame) -> DataFrame:
    """Edges of records: src_url, src_title, pos, href, text, rel."""
    rows = records.select(F.col("url").alias("src_url"), F.col("title").alias("src_title"), F.posexplode("links").alias("pos", "link"))
    return rows.select("src_url", "src_title", "pos", "link.href", "link.text", "link.rel")


class _Anchors:
    """Rows of one page for the table function `anchors(html, url)`: pos, text, href, raw, rel, link_title."""

    def eval(self, page: str | None, url: str | None) -> Iterator[tuple]:
        for pos, x in enumerate(extract(page, url, frozenset({"links"}))["links"]):
            yield pos, x["text"], x["href"], x["raw"], x["rel"], x["link_title"]


class _Images:
    """Rows of one page for the table function `images(html)`: pos, src, alt, title, width, height, srcset, loading, class_list."""

    def eval(self, page: str | None) -> Iterator[tuple]:
        for pos, x in enumerate(extract(page, None, frozenset({"images"}))["images"]):
            yield pos, x["src"], x["alt"], x["title"], x["width"], x["height"], x["srcset"], x["loading"], x["class_list"]


anchors = F.udtf(_Anchors, returnType="pos long, text string, href string, raw string, rel string, link_title string", useArrow=True)
images = F.udtf(
    _Images,
    returnType="pos long, src string, alt string, title string, width string, height string, srcset string, loading string, class_list array<string>",
    useArrow=True,
)


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL: `SELECT url, a.* FROM pages, LATERAL anchors(html, url) a`."""
    spark.udtf.register("anchors", anchors)
    spark.udtf.register("images", images)
