from __future__ import annotations

import pytest
from parity import assert_same, connect

from sitelume.plans.catalogue import ORACLE_SQL, QUERIES
from sitelume.plans.fixtures import crawl


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(n for n in ORACLE_SQL if not n.startswith("html_") or n[5:] not in ORACLE_SQL))
def test_query_equals_its_oracle(spark, data, con, name):
    assert_same(QUERIES[name](spark, data), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_oracle_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_scans_read_only_what_is_needed(spark, data):
    plan = QUERIES["url_ids"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[1]


def test_batch_and_stream_limiter_agree(spark, data):
    batch, stream = QUERIES["sliding_limiter"](spark, data), QUERIES["streaming_limiter"](spark, data)
    key = ["user_id", "seq", "is_admitted"]
    assert sorted(batch.select(key).collect()) == sorted(stream.select(key).collect())


@pytest.mark.parametrize("name", ["title_issues", "meta_description_issues", "h1_issues", "thin_content"])
def test_html_queries_leave_pdf_pages_out(spark, data, name):
    others = crawl(spark, data).where("page_id % 19 = 0 OR page_id % 37 = 0 AND page_id % 31 <> 0").select("url")
    assert others.count() > 0
    assert QUERIES[name](spark, data).join(others, "url").count() == 0


def test_no_oracle_is_empty(con):
    """A query whose oracle has no row on the test tables would prove nothing."""
    empty = [n for n, sql in ORACLE_SQL.items() if not con.sql(f"SELECT count(*) FROM ({sql})").fetchall()[0][0]]
    assert set(empty) <= {"orphaned_redirects"}  # it has rows on the larger tables
