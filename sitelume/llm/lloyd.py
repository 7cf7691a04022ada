"""Centroid clustering by Delta Lloyd: rounds that compare and add up only what changed."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, only
from .vectors import matrix

#: Largest value of a long; sums and distances beyond it are given as this.
MOST = (1 << 63) - 1


def delta_lloyd(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 40,
    rounds: int = 5,
    components: int = 64,
    scale: int = 256,
    seed: str = "2",
) -> DataFrame:
    """Clusters of integer vectors: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x). The first centroids are the `k` vectors
    with the smallest sha256 of "<seed>:<id>". Each of `rounds` rounds assigns
    every vector to the nearest centroid (squared distance, ties to the smaller
    number) and moves each centroid to the floor of its vectors' mean; after the
    last round vectors are assigned once more. A centroid without vectors stays.

    The state of the table (owner and distance of each vector) is written after
    each round. A round compares a vector with the centroids that moved in the
    round before; only vectors whose own centroid moved are compared with all.
    Vectors that changed owners are added to the new one's sum and taken from
    the old one's; the sums of all clusters (k times `components` numbers) are
    all that the driver holds.

    Vectors that are null, of another length, or hold null or non-finite
    components take no part. Rows without an id are clustered too, but start no
    centroid unless there are fewer than `k` others. Repeated rows count each
    time. Fewer than `k` vectors: as many centroids. Empty table: no rows.
    Extra columns are ignored. Whole numbers are exact at any size; distances
    and sums beyond a long are given as its largest value.
    """
    scratch = Scratch(df.sparkSession)
    state = scratch.keep(_whole_vectors(df, id_col, vector_col, components, scale))
    first = state.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vec").limit(k)
    centroids = [tuple(r.vec) for r in first.select("vec").collect()]  # k rows
    if not centroids:
        return state.select(
            "vec_id", "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256")
        )
    sums = [[0] * components for _ in centroids]
    counts = [0] * len(centroids)
    changed = list(range(len(centroids)))
    for turn in range(rounds + 1):
        if changed:  # else every vector stays where it is
            assigned = scratch.keep(state.mapInArrow(_assigner(centroids, changed), state.schema))
            scratch.drop(state)
            state = assigned
        if turn < rounds and changed:
            for cluster, at, value in _transfers(state).collect():  # at most k * (components + 1) rows
                if at < 0:
                    counts[cluster] += int(value)
                else:
                    sums[cluster][at] += int(value)
            moved = [tuple(s // n for s in total) if n else old for total, n, old in zip(sums, counts, centroids, strict=True)]
            changed = [c for c, (new, old) in enumerate(zip(moved, centroids, strict=True)) if new != old]
            centroids = moved
    return _report(state, centroids)


def _whole_vectors(df: DataFrame, id_col: str, vector_col: str, components: int, scale: int) -> DataFrame:
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = only(df, vec_id=id_col, vec=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec"))
    vectors = vectors.where((F.size("vec") == components) & ~bad)
    none = F.lit(None)
    return vectors.select(
        "vec_id", F.transform("vec", lambda x: F.floor(x * scale)).alias("vec"),
        none.cast("int").alias("was"), none.cast("int").alias("cluster"), none.cast("long").alias("distance"),
    )


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors to whole centroids: in doubles where all sums stay below 2**53, else in Python's integers."""
    most = max(int(np.abs(a).max(initial=0)) for a in (x.astype(object) if x.size and x.min() == -MOST - 1 else x, centroids))
    if 4 * x.shape[1] * most * most < 1 << 53:
        x, centroids = x.astype(float), centroids.astype(float)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)).astype(np.int64)
    x, centroids = x.astype(object), centroids.astype(object)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def nearest(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and distance of each vector after the centroids of `changed` moved; an owner of -1 is none yet.

    The owner of a vector whose centroid stayed is still the best of those that
    stayed, so it meets the changed ones only.
    """
    owner, distance = owner.copy(), distance.copy()
    loose = (owner < 0) | np.isin(owner, changed)
    if loose.any():
        d = squared_distances(x[loose], centroids)
        best = d.argmin(axis=1)  # the smaller number of equals
        owner[loose], distance[loose] = best, _capped(d[np.arange(len(d)), best])
    if not loose.all():
        kept = np.flatnonzero(~loose)
        d = squared_distances(x[kept], centroids[changed])
        best = d.argmin(axis=1)
        rival, away = changed[best], d[np.arange(len(d)), best]
        own = distance[kept]
        if (own == MOST).any():  # capped, so compared anew
            own = np.array([int(squared_distances(x[[i]], centroids[[owner[i]]])[0, 0]) for i in kept], object)
        wins = ((away < own) | ((away == own) & (rival < owner[kept]))).astype(bool)
        owner[kept[wins]], distance[kept[wins]] = rival[wins], _capped(away[wins])
    return owner, distance


def _capped(d: np.ndarray) -> np.ndarray:
    return d if d.dtype == np.int64 else np.array([min(int(v), MOST) for v in d], np.int64)


def _whole_matrix(rows: list[tuple[int, ...]]) -> np.ndarray:
    return np.array(rows, np.int64)


def _assigner(centroids: list[tuple[int, ...]], changed: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, moved = _whole_matrix(centroids), np.array(changed)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(pa.chunked_array([batch["vec"]]))
            owner = batch["cluster"].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            cluster, distance = nearest(x, owner, batch["distance"].fill_null(0).to_numpy(zero_copy_only=False).copy(), points, moved)
            columns = [batch["vec_id"], batch["vec"], batch["cluster"], pa.array(cluster.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vec", "was", "cluster", "distance"])

    return run


def _transfers(state: DataFrame) -> DataFrame:
    """What each cluster gains (and loses) by vectors that changed owners: cluster, at (component; -1: vectors), value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(pa.chunked_array([batch["vec"]]))
            if int(np.abs(x.astype(float)).max()) * len(x) >= 1 << 62:
                x = x.astype(object)
            for name, sign in (("was", -1), ("cluster", 1)):
                owner = batch[name].fill_null(-1).to_numpy(zero_copy_only=False)
                for c in np.unique(owner[owner >= 0]):
                    own = x[owner == c]
                    n, total = gains.get(int(c), (0, [0] * x.shape[1]))
                    gains[int(c)] = n + sign * len(own), [t + sign * int(v) for t, v in zip(total, own.sum(axis=0), strict=True)]
        rows = [(c, at, Decimal(v)) for c, (n, total) in gains.items() for at, v in enumerate([n, *total], -1)]
        kinds = [("cluster", pa.int32()), ("at", pa.int32()), ("value", pa.decimal128(38, 0))]
        arrays = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(kinds))

    moved = state.where(~F.col("was").eqNullSafe(F.col("cluster"))).select("vec", "was", "cluster")
    return moved.mapInArrow(run, "cluster int, at int, value decimal(38,0)").groupBy("cluster", "at").agg(F.sum("value").alias("value"))


def _report(state: DataFrame, centroids: list[tuple[int, ...]]) -> DataFrame:
    spark = state.sparkSession
    own = {r.cluster: int(r.d) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    points = [(c, min(own.get(c, 0), MOST), ",".join(map(str, point))) for c, point in enumerate(centroids)]
    table = spark.createDataFrame(points, "cluster int, cluster_inertia long, point string").select(
        "cluster", "cluster_inertia", F.lit(min(sum(own.values()), MOST)).cast("long").alias("inertia"), F.sha2("point", 256).alias("centroid_sha256")
    )
    told = state.join(F.broadcast(table), "cluster")  # k rows
    return told.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
