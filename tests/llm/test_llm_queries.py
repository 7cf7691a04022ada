from __future__ import annotations

import pytest
from parity import assert_same, connect

from sitelume.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - {"op4_line_dedup"}))
def test_query_equals_its_oracle(spark, data, name):
    assert_same(QUERIES[name](spark, data), connect(data), ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["op2_bradley_terry_quality", "op6_language_id", "op7_lookup_sharding", "op8_toxicity_lexicon"])
def test_query_has_a_row_for_each_document(spark, data, documents, name):
    found = QUERIES[name](spark, data)
    assert found.count() == documents.count()
    assert found.select("doc_id").distinct().count() == documents.count()
