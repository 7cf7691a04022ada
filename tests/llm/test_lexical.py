from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelume.llm.lexical import FILTER_BITS, _term_filter, _Wanted, build_treaps, rank_documents, walk

DOCS = "doc_id long, text string, item_id long, score int"
ITEMS = "item_id long, text string, rank int, doc_id long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, n, doc, -s) for n, (s, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, 2) for i, t in docs], DOCS).repartition(3),
        spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS),
    )


def found(spark, docs, items, **options):
    return sorted(str(tuple(r)) for r in rank_documents(*frames(spark, docs, items), **options).collect())


def corpus(n=400, seed=1):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["été", "ÉTÉ", "naïve", "Wort", "WORT"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(draw.choices(words, weights, k=draw.randrange(1, 60)))) for k in range(n)]
    items = [(k, " ".join(draw.choices(words, k=draw.randrange(1, 12)))) for k in range(25)]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    docs += [docs[3]] * 3 + [(3, "w1 other"), (None, docs[5][1]), (None, docs[5][1]), (900, None), (901, ""), (902, " .,;\n"), (903, "w2 " * 5000)]
    docs += [(1000 + k, docs[7][1]) for k in range(50)]  # ties
    items += [items[0], (500, None), (501, ""), (502, "unknown terms only"), (None, "w1 w5"), (503, docs[7][1]), (0, "w3 w3 W3")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, k=1) == brute(docs, items, 1)


def test_many_blocks_of_items_and_documents(spark, monkeypatch):
    monkeypatch.setattr("sitelume.llm.lexical.BLOCK_TERMS", 20)
    docs, items = corpus(200, 2)
    assert found(spark, docs, items) == brute(docs, items)


def test_no_documents_and_no_items(spark):
    docs, items = corpus(20)
    assert found(spark, [], items) == [] == found(spark, docs, [])
    assert found(spark, [(1, None)], items) == []
    assert found(spark, docs, [(1, "unknown")]) == []


def test_treaps_are_search_trees_and_heaps():
    random_ = np.random.default_rng(3)
    keep = random_.random((20, 500)) < random_.random((20, 1))
    term, doc = np.nonzero(keep)
    impact = random_.integers(1, 5, len(doc))  # many ties
    t = build_treaps(term, doc, impact, 20)

    def check(node, low, high, top):
        if node < 0:
            return 0, 0
        assert low <= t.doc[node] < high and t.impact[node] <= top
        a, depth_a = check(t.left[node], low, t.doc[node], t.impact[node])
        b, depth_b = check(t.right[node], t.doc[node] + 1, high, t.impact[node])
        return a + b + 1, max(depth_a, depth_b) + 1

    for k in range(20):
        size, depth = check(t.roots[k], 0, 500, 5)
        assert size == keep[k].sum() and depth < 60


@pytest.mark.parametrize("floor", [0, 900])
def test_walk_prunes_and_finds_the_best(floor, monkeypatch):
    random_ = np.random.default_rng(4)
    keep = random_.random((12, 4000)) < 0.3
    term, doc = np.nonzero(keep)
    impact = (random_.pareto(1.5, len(doc)) * 20).astype(np.int64) + 1
    t = build_treaps(term, doc, impact, 12)
    weights = random_.integers(1, 9, 12)
    total = np.zeros(4000, np.int64)
    np.add.at(total, doc, impact * weights[term])
    want = [d for d in np.lexsort((np.arange(4000), -total))[:10] if total[d] >= max(floor, 1)]
    for frontier in (4_000_000, 60):
        monkeypatch.setattr("sitelume.llm.lexical.FRONTIER", frontier)
        best, score, scored = walk(t, np.arange(12), weights, 4000, 10, floor)
        assert best.tolist() == want and score.tolist() == total[want].tolist()
        assert scored < 1500


def test_filter_has_every_term(spark):
    words = [b"a", "été".encode(), b"x" * 3000, *(f"w{k}".encode() for k in range(500))]
    wanted = _Wanted(_term_filter(spark.createDataFrame([(bytearray(w),) for w in words], "term binary")))
    assert all(wanted[w] for w in words)
    assert sum(wanted[f"z{k}".encode()] for k in range(2000)) < 20
    assert FILTER_BITS == len(wanted.bits) * 8


def test_blocks_of_documents(spark):
    """More documents than a task's block, in one partition."""
    docs = [(k, f"w{k % 7} w{k % 11} w{k % 13}") for k in range(9000)]
    items = [(1, "w1 w12"), (2, "w3"), (3, "w0 w5 w9 w10")]
    d, i = frames(spark, docs, items)
    got = rank_documents(d.orderBy(F.desc("doc_id")).coalesce(1), i).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(docs, items)
