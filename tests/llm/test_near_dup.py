from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from sitelume.llm.near_dup import band_count, near_duplicates, one_of_each


def brute_force(rows, percent, size=5):
    """Components of documents by comparing every pair of shingle sets, in plain Python."""
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = find(a), find(b)
                parent[max(r, s)] = min(r, s)
    return {d: (len(sets[d]), find(d)) for d in ids}


def check(df, rows, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, percent=percent).collect()}
    assert got == brute_force(rows, percent)


def test_table_equals_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check(documents, rows, 85)


def test_chains_and_hot_groups_equal_brute_force(spark):
    random.seed(5)
    rows, base = [], [f"w{random.randrange(10**6)}" for _ in range(120)]
    for k in range(150):  # near copies around the threshold, so that components are chains
        words = list(base)
        for _ in range(k % 7):
            words[random.randrange(120)] = f"x{random.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(200 + k, "Same  TEXT again and again") for k in range(40)]
    rows += [(300, "same text again and AGAIN"), (301, "one two"), (302, "one\ttwo"), (303, "two one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows, 85)
    check(df, rows, 80)


def test_odd_rows(odd, empty):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[1].component_id, by[2].component_id, by[2].kept) == (1, 1, False)
    assert all(by[k].n_shingles == 0 and by[k].kept and by[k].component_id == k for k in (3, 4, 5))
    assert by[7].component_id == 6
    nulls = sorted((r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None)
    assert nulls[0] == (0, None, True)
    assert nulls[1] == (3, 1, False)
    assert near_duplicates(empty).collect() == []


def test_one_of_each_keeps_columns(odd, empty):
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where(F.col("doc_id").isNotNull()).collect()) == [1, 3, 4, 5, 6, 8, 9]
    assert one_of_each(empty).count() == 0


def test_bands():
    for percent in (80, 85, 90):
        assert (1 - (percent / 100) ** 5) ** band_count(percent) <= 1e-5
