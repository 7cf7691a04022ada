"""Page records of texts cut within an entity, as titles are, against their oracle SQL."""

from __future__ import annotations

import os
import re

import pytest
from parity import assert_same, connect

from sitelume.operators import html
from sitelume.plans.catalogue import ORACLE_SQL, QUERIES

WHOLE = "a &amp; b, token = &quot;k&quot; &copy; 5 &middot; c"
CUTS = [WHOLE[:n] for n in range(len(WHOLE) + 1)]
OTHERS = ["&quotation;", "&amp;quot", "&amp;quot;", "&ampquot;", "&copy&quot&middot", "&&quot", "&quot &quot;", "\ufdd0 &quot", "\ufdd0", "&quot;&quot"]


@pytest.fixture(scope="module")
def cut(data, tmp_path_factory):
    """The tables of `data` with pages of such titles, some with an article of about the length that makes it the main content."""
    folder = str(tmp_path_factory.mktemp("cut"))
    for name in os.listdir(data):
        if name != "pages.parquet":
            os.symlink(f"{data}/{name}", f"{folder}/{name}")
    con, pages = connect(data), []
    for title in CUTS + OTHERS:
        for size in (0, 84 - len(title), 88 - len(title), 89 - len(title), 300):
            article = f"<h1>{title}</h1><p>{'x' * size}"  # 12 characters of tags
            pages.append((f"https://e.example/{len(pages)}", f"<html><head><title>{title}</title></head><body><article>{article}</article><p>{title}</p>"))
    con.sql("CREATE TABLE cut (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO cut VALUES (?, ?, ?)", [(n, *page) for n, page in enumerate(pages)])
    con.sql(f"COPY cut TO '{folder}/pages.parquet' (FORMAT parquet)")
    return folder


def test_cut_entities(spark, cut):
    con, sql = connect(cut), ORACLE_SQL["full_page_record"]
    assert_same(QUERIES["full_page_record"](spark, cut), con, sql)
    assert con.sql(f"SELECT count(*) FROM ({sql}) WHERE title LIKE '%token = &quot'").fetchall() == [(5,)]
    assert len(con.sql(f"SELECT DISTINCT main_selector FROM ({sql})").fetchall()) == 2


def test_bare_names_stay_text_where_asked():
    """As if their sign were written out; what is cut out of the source is as it is there."""
    for text in CUTS + OTHERS:
        page = f'<title>{text}</title><meta name="k" content="{text}"><main><h2>{text}</h2><p>{text}<a href="/?{text}">{text}</a></main>{"x" * 99}'
        got = html.extract(page, "https://e.example/", bare_names=False)
        want = html.extract(re.sub("&(?=(copy|middot|quot)(?!;))", "&amp;", page), "https://e.example/")
        cut_out = {"full_html": page, "main_html": page[page.index("<main>") + 6 : page.index("</main>")]}
        if len(cut_out["main_html"]) <= 100:
            cut_out = {"full_html": page, "main_html": page}
        assert got == want | cut_out | {"main_selector": got["main_selector"]}


def test_bare_names_are_decoded_as_browsers_do():
    assert html.extract("<title>token = &quot</title>", None)["title"] == 'token = "'
