from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from sitelume.llm.lloyd import MOST, delta_lloyd, nearest, squared_distances

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string"


def lloyd(rows, k, rounds, scale=256):
    """Every round anew, in Python's integers."""
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    for turn in range(rounds + 1):
        owner = []
        for _, v in kept:
            owner.append(min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)))
        if turn < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, o) in zip(kept, owner, strict=True) if o == n]
                if own:
                    centroids[n] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    cost = {n: sum(d for d, o in owner if o == n) for n in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), o, min(d, MOST), min(cost[o], MOST), min(sum(cost.values()), MOST), sha[o]) for (i, _), (d, o) in zip(kept, owner, strict=True))


def found(df, **options):
    got = delta_lloyd(df, **options).collect()
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_equals_plain_rounds(spark, rounds):
    random = np.random.default_rng(5)
    x = random.normal(size=(300, 3)) + random.integers(-3, 4, size=(300, 1))
    rows = [(k, [float(v) for v in x[k]]) for k in range(300)]
    rows += [rows[7]] * 40 + [(1000, rows[9][1]), (None, [0.5, -0.25, 1.0]), (1001, [-0.0, 0.0, -0.001])]
    odd = [(2000, None), (2001, [1.0, None, 2.0]), (2002, [math.nan, 0.0, 0.0]), (2003, [math.inf, 0.0, 0.0]), (2004, [1.0]), (None, None)]
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows + odd], SCHEMA).repartition(5)
    assert found(df, k=7, rounds=rounds, components=3) == lloyd(rows, 7, rounds)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(k, [float(k % 3), 0.0]) for k in range(30)]  # equal vectors: equal centroids, all but one of them empty
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], SCHEMA)
    got = found(df, k=12, components=2)
    assert got == lloyd(rows, 12, 5)
    assert len({r[1] for r in got}) == 3


def test_large_components_stay_exact(spark):
    rows = [(k, [float(2 ** (30 + k % 9)) * (-1) ** k, float(k)]) for k in range(40)]
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], SCHEMA)
    assert found(df, k=5, components=2) == lloyd(rows, 5, 5)


def test_few_and_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert delta_lloyd(empty).collect() == []
    assert delta_lloyd(empty).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    two = [(1, [0.25, 1.0]), (2, [0.5, 1.0])]
    assert found(spark.createDataFrame([(i, v, 9, "x") for i, v in two], SCHEMA), components=2) == lloyd(two, 40, 5)


def test_only_changed_centroids_are_met(monkeypatch):
    random = np.random.default_rng(2)
    x, centroids = random.integers(-50, 50, (200, 4)), random.integers(-50, 50, (9, 4))
    owner = squared_distances(x, centroids).argmin(axis=1)
    distance = squared_distances(x, centroids)[np.arange(200), owner]
    moved = centroids.copy()
    moved[[2, 5]] += 3
    met = []
    plain = squared_distances
    monkeypatch.setattr("sitelume.llm.lloyd.squared_distances", lambda a, b: met.append(len(a) * len(b)) or plain(a, b))
    now, away = nearest(x, owner, distance, moved, np.array([2, 5]))
    whole = plain(x, moved)
    assert (now == whole.argmin(axis=1)).all() and (away == whole.min(axis=1)).all()
    loose = np.isin(owner, [2, 5]).sum()
    assert sum(met) == loose * 9 + (200 - loose) * 2
