"""Queries over pages of which many have the same URL, against their oracle SQL."""

from __future__ import annotations

import os

import pytest
from parity import assert_same, connect

from sitelume.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def repeated(spark, data, tmp_path_factory):
    """The tables of `data`, with 140 pages at few URLs."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    for name in os.listdir(data):
        if name != "pages.parquet":
            os.symlink(f"{data}/{name}", f"{folder}/{name}")
    source = f"{data}/pages.parquet"
    connect(data).sql(
        f"""COPY (SELECT n AS page_id, q.url, p.html FROM range(140) r(n) JOIN '{source}' p ON p.page_id = n % 50
        JOIN '{source}' q ON q.page_id = CASE WHEN n % 5 = 0 THEN 20 + n % 2 * 5 ELSE n % 34 % 11 END ORDER BY n) TO '{folder}/pages.parquet' (FORMAT parquet)"""
    )
    return folder


NAMES = [
    "audit_broken_links",
    "link_totals_per_page",
    "internal_link_stats",
    "page_analysis",
    "issue_counts",
    "html_issue_counts",
    "roadmap_tasks",
    "executive_summary",
    "broken_targets",
    "broken_summary",
    "probe_status_distribution",
    "reverified_probes",
    "diff_against_index",
    "incremental_share",
    "incremental_urls",
    "removed_urls",
    "sitemap_diff",
    "incremental_first",
]


@pytest.mark.parametrize("name", NAMES)
def test_repeated_urls(spark, repeated, name):
    assert_same(QUERIES[name](spark, repeated), connect(repeated), ORACLE_SQL[name])


def test_headings_of_repeated_urls(spark, repeated):
    """Headings of several records of a URL; its SQL leaves the order of those at one place open."""
    told = lambda rows: sorted((url, sorted(headings.split(" | ")), excerpt) for url, headings, excerpt in rows)
    columns = ["url", "headings", "excerpt"]
    want = connect(repeated).sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['fix_contexts']})").fetchall()
    got = QUERIES["fix_contexts"](spark, repeated).select(*columns).collect()
    assert told(got) == told(want)
    assert any(" | " in r.headings for r in got)
