"""Shared parts of the vector searches: valid vectors, blocks of queries and of data, merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import numbered, running
from .scratch import Scratch, only

#: Numbers (components) of one block of data and of one block of queries, about: 20 MB each as doubles.
BLOCK_NUMBERS = 2_500_000
#: Smaller tables are cut further, to so many blocks of so many rows at least.
LEAST_BLOCKS, LEAST_ROWS = 24, 256
#: One row in so many is searched first, to tell each query a score that its k-th best reaches at least.
SAMPLE = 16
#: Rows found by a task that are held before all but the best are dropped.
HELD = 1_000_000

#: (query ids, queries, least scores, ids, vectors) to (query_id, vec_id, score) arrays.
Task = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec (doubles) of rows with an id and a vector without null or non-finite components."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = only(df, vec_id=id_col, vec=vector_col).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec")
    )
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & ~bad)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, every: int, k: int, task: Task, score_type: str, scratch: Scratch | None = None) -> DataFrame:
    """The `k` best of all vectors for those whose id is divisible by `every`: query_id, rank, vec_id, score.

    Vectors are dealt once to blocks of about BLOCK_NUMBERS numbers, by a hash of
    id and vector; blocks and their number depend on the rows alone, so neither
    the cores nor the partitions of a run change what is found. Each block is
    written as one row. Queries, a block of bounded size at a time, are broadcast
    to tasks that read the data blocks and give k rows for each query, so the
    table itself is shuffled once, however many queries there are. First a
    block of queries meets one row in SAMPLE: the k-th best score found there is
    one that the k-th best of all reaches at least, so tasks need not look for
    less. Vectors meet vectors of their own length; equal rows are kept once,
    with their number.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    rows = vectors.groupBy("vec_id", "vec").agg(F.count("*").alias("copies"))
    rows = scratch.keep(rows.select("vec_id", "vec", "copies", F.size("vec").alias("d"), F.xxhash64("vec_id", "vec").alias("h")))
    # of several vectors of one id the longest, then the least, is the query
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct(-F.col("d"), "vec")).alias("v"))
    queries = numbered(queries.select(F.col("vec_id").alias("query_id"), "v.vec", F.size("v.vec").alias("d")), [F.col("d"), F.col("query_id")], "place", scratch)
    queries = scratch.keep(running(queries, "d", "place", "before").select("query_id", "vec", "d", "place", F.floor(F.col("before") / BLOCK_NUMBERS).alias("q_block")))
    last = queries.agg(F.max("q_block")).first()[0]
    schema = f"query_id long, vec_id long, score {score_type}"
    if last is None:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score_type}")

    data = scratch.keep(_blocks(rows, scratch))
    sample = scratch.keep(_blocks(rows.where(F.pmod("h", F.lit(SAMPLE)) == 0).withColumn("h", F.floor(F.col("h") / SAMPLE)), scratch))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = []
    for block in range(last + 1):  # one for each BLOCK_NUMBERS numbers of the queries
        own = queries.where(F.col("q_block") == block).toArrow().sort_by("place")
        first = sample.mapInArrow(_meet(spark.sparkContext.broadcast((own, None)), k, task, score_type), schema)
        floors = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", "score").toArrow()
        part = data.mapInArrow(_meet(spark.sparkContext.broadcast((own, floors)), k, task, score_type), schema)
        found.append(scratch.keep(part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)))
    return reduce(DataFrame.unionByName, found).select("query_id", "rank", "vec_id", "score")


def _blocks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks of rows of one length as rows: d, ids, vectors and copies (numbers as bytes), each block in the order of its ids."""
    small = F.least(F.lit(LEAST_BLOCKS), F.ceil(F.col("n") / LEAST_ROWS))
    lengths = rows.groupBy("d").agg(F.count("*").alias("n"))
    lengths = scratch.keep(lengths.select("d", F.greatest(F.ceil(F.col("n") * F.col("d") / BLOCK_NUMBERS), small).cast("long").alias("blocks")))
    parts = max(1, min(lengths.agg(F.sum("blocks")).first()[0] or 0, 20_000))
    # bounded: a row for each length, at most as many as an array may have
    dealt = rows.join(F.broadcast(lengths), "d").withColumn("block", F.pmod("h", "blocks")).repartition(parts, "d", "block")

    def pack(block: pa.Table) -> pa.Table:
        order = np.lexsort((block["h"].to_numpy(), block["vec_id"].to_numpy()))
        whole = [block["vec_id"].to_numpy()[order], matrix(block["vec"])[order], block["copies"].to_numpy()[order]]
        return pa.table({"d": block["d"].slice(0, 1), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("ids", "vectors", "copies"), whole, strict=True)}})

    return dealt.groupBy("d", "block").applyInArrow(pack, "d int, ids binary, vectors binary, copies binary")


def _meet(shared: Broadcast, k: int, task: Task, score_type: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best of a task's blocks for each query of a block; a query's floor is where `task` may stop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, told = shared.value
        ids, lengths = table["query_id"].to_numpy(), table["d"].to_numpy()
        floors = np.full(len(ids), -np.inf)
        if told is not None:
            known = dict(zip(told["query_id"].to_pylist(), told["score"].to_pylist(), strict=True))
            floors = np.array([known.get(i, -np.inf) for i in ids.tolist()], float)
        # the queries stand in the order of their lengths
        of_length = {}
        for d in np.unique(lengths):
            a, b = np.searchsorted(lengths, [d, d + 1])
            of_length[int(d)] = ids[a:b], matrix(table["vec"].slice(a, b - a)), floors[a:b]
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for d, *block in zip(*(batch[c].to_pylist() for c in ("d", "ids", "vectors", "copies")), strict=True):
                if d not in of_length:
                    continue
                near, data, copies = (np.frombuffer(x, kind) for x, kind in zip(block, (np.int64, float, np.int64), strict=True))
                times = np.minimum(copies, k)  # more of equal rows are never among the best
                query, other, score = task(*of_length[d], np.repeat(near, times), np.repeat(data.reshape(-1, d), times, axis=0))
                held.append((query, other, score))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [_best_of_each(held, k)]
        if held:
            kinds = (pa.int64(), pa.int64(), pa.int64() if score_type == "long" else pa.float64())
            arrays = [pa.array(x, kind) for x, kind in zip(_best_of_each(held, k), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

    return run


def _best_of_each(held: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query, ties to the smaller id."""
    query, other, score = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((other, -score, query))
    query = query[order]
    starts = np.flatnonzero(np.diff(query, prepend=query[:1] - 1)) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    order = order[place < k]
    return query[place < k], other[order], score[order]


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]
