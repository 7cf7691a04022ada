from __future__ import annotations

import json
import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from sitelume.llm import vectors as vectors_module
from sitelume.llm.ann import count_collisions, nearest_by_collisions
from sitelume.llm.topk import exact_top_k, scan_blocks

ROOT = Path(__file__).resolve().parent.parent.parent
SCHEMA = "vec_id long, embedding array<float>, score int"


def vectors(spark, n=900, d=12, seed=3):
    random = np.random.default_rng(seed)
    x = random.standard_normal((n, d)).astype(np.float32)
    x[5] = x[4]  # ties
    rows = [(k, [float(v) for v in x[k]], 1) for k in range(n)]
    odd = [(1000, None, 1), (1100, [1.0, None] + [0.0] * (d - 2), 1), (1200, [math.nan] * d, 1), (1300, [math.inf] * d, 1), (1400, [], 1), (None, [1.0] * d, 1), (1500, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows + odd, SCHEMA), x.astype(float)


def test_exact_top_k_equals_brute_force(spark):
    df, x = vectors(spark)
    whole = np.floor(x * 1024).astype(np.int64)
    got = {}
    for r in exact_top_k(df, block_rows=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 100))
    for q, rows in got.items():
        score = whole @ whole[q]
        best = sorted((-score[k], k) for k in range(900) if k != q)[:10]
        assert sorted(rows) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]


def test_large_components_stay_exact(spark):
    rows = [(k, [float(2**20 + k), float(-k)], 1) for k in range(0, 300, 50)]
    got = exact_top_k(spark.createDataFrame(rows, SCHEMA), scale=1 << 10).where("query_id = 100").orderBy("rank").collect()
    x = {k: [int(v) << 10 for v in vec] for k, vec, _ in rows}
    want = sorted((-sum(a * b for a, b in zip(x[100], x[k], strict=True)), k) for k in x if k != 100)
    assert [(r.vec_id, r.score) for r in got] == [(k, -s) for s, k in want]


def test_many_blocks_of_queries_and_data(spark, monkeypatch):
    monkeypatch.setattr(vectors_module, "BLOCK_NUMBERS", 40)  # a few vectors each
    monkeypatch.setattr(vectors_module, "LEAST_ROWS", 16)
    df, x = vectors(spark)
    small = df.where("vec_id < 300 OR vec_id IS NULL")
    whole = np.floor(x[:300] * 1024).astype(np.int64)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_top_k(small, every=20).collect()}
    for q in range(0, 300, 20):
        score = whole @ whole[q]
        best = sorted((-score[k], k) for k in range(300) if k != q)[:10]
        assert [got[q, n + 1] for n in range(10)] == [(k, -s) for s, k in best]


def test_repeated_ids_and_lengths(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (3, [0.5, 0.25], 1), (3, [0.5, 0.25], 1), (0, [4.0], 1), (100, [1.0], 1), (7, [2.0], 1)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in exact_top_k(spark.createDataFrame(rows, SCHEMA)).collect())
    # the query of id 0 is its longest vector, the least of those; each row of id 3 is a candidate
    assert [g for g in got if g[0] == 0] == [(0, 1, 3, 256 * 1024), (0, 2, 3, 256 * 1024)]
    assert [g[1:3] for g in got if g[0] == 100] == [(1, 0), (2, 7)]


def test_blocks_are_skipped_where_vectors_are_clustered():
    random = np.random.default_rng(4)
    centres = random.standard_normal((60, 64))
    x = centres[random.integers(0, 60, 6_000)] + 0.3 * random.standard_normal((6_000, 64))
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True))
    ids = np.arange(6_000)
    (q, near, score), scored, every = scan_blocks(ids[::100], x[::100], np.full(60, -np.inf), ids, x, 10, 128)
    assert scored < 0.1 * every
    for n in range(60):
        product = x @ x[100 * n]
        best = sorted((-product[k], k) for k in range(6_000) if k != 100 * n)[:10]
        assert sorted(zip(-score[q == 100 * n], near[q == 100 * n], strict=True)) == best


def test_recall_on_the_real_table(spark):
    """Against brute force over the whole table, with the share of pairs that were verified."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    ids, x = np.array(sorted(rows)), np.stack([rows[k] for k in sorted(rows)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in nearest_by_collisions(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    wanted = [k for k in ids if k % 50 == 0]
    for q in wanted:
        cosine = unit @ unit[ids == q][0]
        cosine[ids == q] = -np.inf
        hit += len({int(ids[k]) for k in np.argsort(-cosine, kind="stable")[:5]} & got[q])
    assert hit >= 0.9 * 5 * len(wanted)
    queries = np.flatnonzero(ids % 50 == 0)
    _, verified = count_collisions(ids[queries], x[queries], np.full(len(queries), -np.inf), ids, x, 5, 160, 0.62, 1.0, 0.5, 1.12)
    assert verified < 0.5 * len(queries) * len(ids)


@pytest.mark.parametrize("search", [exact_top_k, nearest_by_collisions])
def test_results_depend_on_the_rows_alone(spark, search):
    """Other partitions, shuffles and cores give the same rows, of approximate searches too."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    plain = sorted(tuple(r) for r in search(table).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    other = sorted(tuple(r) for r in search(table.repartition(7).orderBy("label")).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plain == other
    code = f"""
import json, sys
sys.path.insert(0, {str(ROOT)!r})
from sitelume.session import build_session
from sitelume.llm.{search.__module__.rsplit(".", 1)[1]} import {search.__name__}
spark = build_session("other", "local[1]", **{{"spark.sql.shuffle.partitions": "3", "spark.ui.showConsoleProgress": "false"}})
rows = {search.__name__}(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect()
print(json.dumps(sorted(tuple(r) for r in rows)))
"""
    told = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert [tuple(r) for r in json.loads(told.splitlines()[-1])] == plain


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, [1.0, 0.0], 1), (2, [0.5, 0.5], 1)] + [(3, [0.9, 0.1], 1)] * 30
    got = [(r["rank"], r.vec_id) for r in exact_top_k(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()]
    assert got == [(n, 3) for n in range(1, 11)]


def test_ties_at_the_last_place(spark):
    """Equal vectors of many ids: the smaller ids win."""
    rows = [(k, [1.0, 0.0], 1) for k in range(40)] + [(40 + k, [0.0, 1.0], 1) for k in range(40)]
    for search, n in ((exact_top_k, 10), (nearest_by_collisions, 5)):
        got = [r.vec_id for r in search(spark.createDataFrame(rows, SCHEMA)).where("query_id = 0").orderBy("rank").collect()]
        assert got == list(range(1, n + 1))


@pytest.mark.parametrize("search", [exact_top_k, nearest_by_collisions])
def test_few_and_no_vectors(spark, search):
    one = spark.createDataFrame([(0, [1.0, 0.0], 1), (3, [0.5, 0.5], 1)], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in search(one).collect()] == [(0, 1, 3)]
    assert search(spark.createDataFrame([], SCHEMA)).collect() == []
    assert search(spark.createDataFrame([(7, [1.0], 1)], SCHEMA)).collect() == []


def test_neighbours_recall_and_scores(spark):
    df, x = vectors(spark, n=3000, d=24)
    df = df.unionByName(spark.createDataFrame([(5000, [0.0] * 24, 1)], SCHEMA))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    got = {}
    for r in nearest_by_collisions(df).collect():
        got.setdefault(r.query_id, []).append(r)
    for q in range(0, 3000, 50):
        cosine = unit @ unit[q]
        best = sorted((-cosine[k], k) for k in range(3000) if k != q)[:5]
        hit += len({k for _, k in best} & {r.vec_id for r in got[q]})
        total += 5
        for r in got[q]:
            assert r.score == pytest.approx(cosine[r.vec_id], abs=1e-12)
        order = [(-r.score, r.vec_id) for r in sorted(got[q], key=lambda r: r["rank"])]
        assert order == sorted(order)
    assert 5000 not in got
    assert hit / total >= 0.9
