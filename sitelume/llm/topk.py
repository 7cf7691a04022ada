"""Exact top-k search by block-at-a-time pruning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best_of, search, valid_vectors

#: Pivot rows for each `block_rows` rows.
PIVOTS = 4


def exact_top_k(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    k: int = 10,
    every: int = 100,
    block_rows: int = 128,
) -> DataFrame:
    """The k highest integer inner products for each query: query_id, rank, vec_id, score.

    Components become floor(scale * x). Queries are the rows whose id is
    divisible by `every`, candidates all rows of another id; ties go to the
    smaller id. Components play the terms of a document; `scan_blocks` prunes
    blocks of rows by their bounds, so the result is exact.

    Null vectors, vectors with null or non-finite components or without an id
    take no part; vectors meet those of their own length. Repeated ids are one
    query (the longest, then least vector) but candidates each. Fewer than k
    candidates: all. Empty table: no rows. Extra columns are ignored.
    """
    whole = valid_vectors(df, id_col, vector_col)
    whole = whole.select("vec_id", F.transform("vec", lambda x: F.floor(x * scale).cast("double")).alias("vec"))

    def task(query_ids, queries, floor, ids, data):
        return scan_blocks(query_ids, queries, floor, ids, data, k, block_rows)[0]

    return search(whole, every, k, task, "long")


def cluster_blocks(data: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and first places of blocks: rows nearest to one of a few pivot rows stand together.

    Bounds of a block are close to its scores where its rows are alike.
    """
    n = len(data)
    unit = data.astype(np.float32)
    unit /= np.maximum(np.sqrt((unit * unit).sum(axis=1, keepdims=True)), 1e-12)
    pivots = unit[:: max(1, n // math.ceil(PIVOTS * n / block_rows))]
    near = np.argmax(unit @ pivots.T, axis=1)
    order = np.argsort(near, kind="stable")
    sizes = np.bincount(near)
    starts = [np.arange(at, at + size, block_rows) for at, size in zip(np.cumsum(sizes) - sizes, sizes, strict=True) if size]
    return order, np.concatenate(starts)


def block_bounds(queries: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The most that each query can score in each block: the smaller of two bounds.

    The first sums, over the components, what the query gains at most by the
    block's largest or smallest component; the second is its score with the
    block's mean and its length times the largest distance from that mean.
    """
    high, low = np.maximum.reduceat(data, starts), np.minimum.reduceat(data, starts)
    bound = (np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T).astype(float)
    size = np.diff(np.append(starts, len(data)))
    mean = np.add.reduceat(data.astype(float), starts) / size[:, None]
    away = data - np.repeat(mean, size, axis=0)
    reach = np.sqrt(np.maximum.reduceat((away * away).sum(axis=1), starts))
    length = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    by_mean = queries @ mean.T + length[:, None] * reach
    slack = 1e-9 * length[:, None] * (np.sqrt((mean * mean).sum(axis=1)) + reach) + 1.0  # rounding must not prune
    return np.minimum(bound, by_mean + slack)


def scan_blocks(
    query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int, block_rows: int
) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int, int]:
    """The best of `data` for each query, with the pairs of query and block that were scored and all pairs.

    A block holds the forward index (components) of rows that are alike. Each
    query scores blocks in the order of their bounds until the bound is below
    its k-th score so far, or below `floor`, which its k-th score is known to
    reach. Queries take one block first and twice as many each time, so that
    those that want the same block score it together.
    """
    # products are exact in doubles while they stay below 2**53
    largest = max(np.abs(queries).max(), np.abs(data).max())
    if largest * largest * data.shape[1] >= 2.0**53:
        queries, data = queries.astype(np.int64), data.astype(np.int64)
    order, starts = cluster_blocks(data, block_rows)
    ids, data = ids[order], data[order]
    ends = np.append(starts[1:], len(ids))
    bound = block_bounds(queries, data, starts)
    turns = np.argsort(-bound, axis=1, kind="stable")
    kth = floor.astype(float).copy()
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
    active, scored, at, step = np.arange(len(queries)), 0, 0, 1
    while len(active) and at < len(starts):
        take = turns[active, at : at + step]
        asking, block = np.repeat(active, take.shape[1]), take.ravel()
        going = bound[asking, block] >= kth[asking]  # an equal score may still win by its id
        asking, block = asking[going], block[going]
        by_block = np.argsort(block, kind="stable")
        asking, block = asking[by_block], block[by_block]
        for who, b in zip(np.split(asking, np.flatnonzero(np.diff(block)) + 1), np.unique(block), strict=False):
            who = who[bound[who, b] >= kth[who]]  # other blocks may have raised it
            if not len(who):
                continue
            scored += len(who)
            rows = slice(starts[b], ends[b])
            scores = queries[who] @ data[rows].T
            some = np.flatnonzero(((scores >= kth[who][:, None]) & (ids[rows] != query_ids[who][:, None])).any(axis=1))
            for q, line in zip(who[some], scores[some], strict=True):
                hit = (line >= kth[q]) & (ids[rows] != query_ids[q])
                score = np.concatenate([found[q][0], line[hit]])
                near = np.concatenate([found[q][1], ids[rows][hit]])
                best = best_of(score, near, k)
                found[q] = score[best], near[best]
                if len(best) == k:
                    kth[q] = max(kth[q], score[best[-1]])
        at, step = at + step, step * 2
        active = active[bound[active, turns[active, at]] >= kth[active]] if at < len(starts) else active[:0]
    out = (
        np.repeat(query_ids, [len(f[0]) for f in found]),
        np.concatenate([f[1] for f in found]).astype(np.int64),
        np.concatenate([f[0] for f in found]).astype(np.int64),
    )
    return out, scored, len(queries) * len(starts)
