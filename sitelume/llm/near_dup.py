"""MinHash near-duplicate detection by min-max hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, only
from .textbytes import mix64, shingle_sets, slices, string_bytes

#: Shingles on either side of one block of exact comparisons, as a mean.
BLOCK_SHINGLES = 200_000


def band_count(percent: int, rows: int = 5, miss: float = 1e-5) -> int:
    """Bands of `rows` values that miss a pair at the threshold with at most probability `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 80,
    size: int = 5,
    rows: int = 5,
    scratch: Scratch | None = None,
    with_body: bool = False,
) -> DataFrame:
    """Group documents whose sets of `size`-word shingles have a Jaccard similarity of `percent` % or more.

    Words are runs without ASCII white space, A-Z lower-cased. Returns for each
    row of `docs`: doc_id, n_shingles (set size), component_id (smallest doc_id
    that links reach, its own included) and kept (doc_id = component_id).

    Each permutation gives two signature values, its minimum and its maximum,
    so a signature costs half the hash evaluations. Texts with equal sets
    become one class; classes that share a band are candidates:

    1. every class against its bucket's smallest class, then components;
    2. in each bucket whose classes are not yet in one component, those outside
       the bucket's main component against all of another component, block by
       block inside tasks. Only confirmed links leave a task.

    All candidates that could join two components are compared, on full sets.

    Null or empty text, or only white space: set size 0, linked with nothing,
    kept, component_id = doc_id. Fewer than `size` words: the whole sequence is
    the one shingle. Null doc_id: takes part and is last, so it is kept only in
    a component without any doc_id. Repeated rows are each returned. Empty
    table: no rows. Extra columns are ignored. With `with_body`, body (hash of
    the text) and node_of (the component) follow.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    docs = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.withColumn("body", F.xxhash64("text"))
    bands = band_count(percent, rows)

    signed = scratch.keep(
        docs.mapInArrow(
            _signer(size, bands, rows), "doc_id long, body long, n_shingles long, node long, bands array<long>"
        )
    )
    # one row for each set: the bands of equal sets are equal
    classes = signed.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    in_bands = classes.select("node", "n", F.explode("bands").alias("bucket"))
    wide = in_bands.groupBy("bucket").agg(
        F.count("*").alias("members"),
        F.min("node").alias("head"),
        F.sum(F.xxhash64("node").cast("decimal(20)")).alias("same"),
    ).where("members > 1")
    # bands often hold the same members; one bucket of each membership is enough
    wide = wide.groupBy("members", "head", "same").agg(F.min("bucket").alias("bucket"))
    members = scratch.keep(in_bands.join(wide.select("bucket", "head"), "bucket"))

    wanted = members.select("node").distinct()
    least = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(wanted, "node")
    sets = scratch.keep(
        docs.join(least.select(F.col("doc_id").alias("want")).distinct(), F.expr("doc_id <=> want"), "left_semi")
        .mapInArrow(_setter(size), "node long, shingles binary")
        .join(wanted, "node", "left_semi")
        .groupBy("node")
        .agg(F.first("shingles").alias("shingles"))
    )

    stars = members.where("node <> head").select("head", "node").distinct()
    stars = scratch.keep(_confirm(stars, sets, percent))
    label = scratch.keep(connected_components(stars, scratch))
    rest = scratch.keep(_residue(members, label, sets, percent, scratch))
    links = stars.unionByName(rest)
    label = scratch.keep(connected_components(links, scratch))

    # members of a component to its smallest doc_id, class by class
    by_class = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    by_class = by_class.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    root = by_class.groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_class = scratch.keep(by_class.join(root, "label").select("node", "component_id", "label"))
    # sets of one document need no lookup; only what shares its set or a link does
    out = signed.select("doc_id", "body", "n_shingles", "node").join(by_class, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    more = ["body", F.col("label").alias("node_of")] if with_body else []
    kept = F.col("doc_id").eqNullSafe(component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *more)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each group of near duplicates, the one of the smallest id; all columns stay.

    A document is an id with a text: rows equal in both are one. In a group
    without any id one document stays. Texts without words all stay.
    """
    body = F.xxhash64(F.col(text_col))
    found = near_duplicates(docs, id_col, text_col, with_body=True, **options)
    kept = found.where("kept")
    kept = kept.where("n_shingles > 0").dropDuplicates(["node_of"]).unionByName(kept.where("n_shingles = 0"))
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("body").alias("kept_body"))
    told = docs.select(F.struct(*docs.columns).alias("row"), body.alias("body"), F.col(id_col).cast("long").alias("id"))
    told = told.join(kept, F.expr("body = kept_body AND id <=> kept_id"), "left_semi").dropDuplicates(["id", "body"])
    return told.select("row.*")


def near_duplicate_links(docs: DataFrame, **options) -> DataFrame:
    """Documents by component: component_id, members (their number), for components of two or more."""
    found = near_duplicates(docs, **options)
    return (
        found.where("n_shingles > 0").groupBy("component_id").agg(F.count("*").alias("members")).where("members > 1")
    )


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets: bijections of the 64-bit hashes."""
    random = np.random.default_rng(20_011)
    draw = random.integers(0, 1 << 63, (2, count), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw[0], draw[1]


def _nodes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set: order-free, as it sums mixed members."""
    counts = np.diff(at).astype(np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes ^ np.uint64(0xA5A5A5A5)))])
        return mix64(total[at[1:]] - total[at[:-1]] + counts * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _signer(size: int, bands: int, rows: int):
    half = (bands * rows + 1) // 2
    factor, plus = _permutations(half)
    salt = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = string_bytes(batch.column(1))
            for a, b in slices(offsets):
                hashes, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                counts = np.diff(at)
                full = np.flatnonzero(counts)
                values = np.empty((len(full), 2 * half), np.uint64)
                start = at[:-1][full]
                with np.errstate(over="ignore"):
                    for k in range(half if len(full) else 0):
                        turned = hashes * factor[k]
                        turned += plus[k]
                        values[:, k] = np.minimum.reduceat(turned, start)
                        values[:, half + k] = np.maximum.reduceat(turned, start)
                    keys = mix64(values[:, : bands * rows] + salt)
                    keys = mix64(keys.reshape(len(full), bands, rows).sum(axis=2, dtype=np.uint64) + salt[:bands])
                lengths = np.zeros(b - a + 1, np.int32)
                lengths[1:][full] = bands
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        batch.column(2)[a:b],
                        pa.array(counts.astype(np.int64)),
                        pa.array(_nodes(hashes, at)),
                        pa.ListArray.from_arrays(
                            pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64))
                        ),
                    ],
                    ["doc_id", "body", "n_shingles", "node", "bands"],
                )

    return sign


def _setter(size: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = string_bytes(batch.column(1))
            for a, b in slices(offsets):
                hashes, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                raw = hashes.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_nodes(hashes, at)),
                        pa.array([raw[8 * x : 8 * y] for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    ],
                    ["node", "shingles"],
                )

    return collect


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (head, node) that reach the similarity on their full sets, as (a, b)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                short, long = (x, y) if len(x) < len(y) else (y, x)
                found = 0
                if 100 * len(short) >= percent * len(long):
                    place = np.searchsorted(long, short)
                    found = int((long[np.minimum(place, len(long) - 1)] == short).sum())
                keep.append(100 * found >= percent * (len(x) + len(y) - found))
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1))], ["a", "b"]
            )

    with_head = pairs.join(sets.select(F.col("node").alias("head"), F.col("shingles").alias("x")), "head")
    both = with_head.join(sets.withColumnRenamed("shingles", "y"), "node")
    return both.select("head", "node", "x", "y").mapInArrow(check, "a long, b long")


def _residue(members: DataFrame, label: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links across components inside a bucket: all outside its main component against all."""
    told = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    told = scratch.keep(told.select("bucket", "node", "n", "label"))
    by_label = told.groupBy("bucket", "label").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
    by_bucket = by_label.groupBy("bucket").agg(
        F.max_by("label", F.struct("members", "label")).alias("main"),
        F.max_by("n", F.struct("members", "label")).alias("main_n"),
        F.sum("n").alias("n_all"),
        F.count("*").alias("labels"),
    )
    open_buckets = by_bucket.where("labels > 1").select(
        "bucket",
        "main",
        F.ceil((F.col("n_all") - F.col("main_n")) / BLOCK_SHINGLES).alias("out_blocks"),
        F.ceil(F.col("n_all") / BLOCK_SHINGLES).alias("all_blocks"),
    )
    told = told.join(open_buckets, "bucket").join(sets, "node")
    part = lambda blocks: F.pmod(F.xxhash64("node", "bucket"), F.col(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    told = told.select("bucket", "node", "label", "main", "shingles", "out_blocks", "all_blocks")
    outside = told.where("label <> main").withColumn("i", part("out_blocks")).withColumn("j", every("all_blocks"))
    inside = told.withColumn("j", part("all_blocks")).withColumn("i", every("out_blocks"))
    columns = ["bucket", "i", "j", "node", "label", "shingles"]
    both = outside.select(*columns, F.lit(True).alias("is_out")).unionByName(
        inside.select(*columns, F.lit(False).alias("is_out"))
    )
    return both.groupBy("bucket", "i", "j").applyInPandas(_crosser(percent), "a long, b long").distinct()


def _crosser(percent: int):
    def cross(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block["is_out"]], block[~block["is_out"]]
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            theirs = [np.frombuffer(x, np.uint64) for x in right["shingles"]]
            size = np.array([len(x) for x in theirs])
            flat, code = np.unique(np.concatenate(theirs), return_inverse=True)
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            labels, nodes = right["label"].to_numpy(), right["node"].to_numpy()
            for node, own, raw in zip(left["node"], left["label"], left["shingles"], strict=True):
                x = np.frombuffer(raw, np.uint64)
                present = np.zeros(len(flat), np.int32)
                place = np.minimum(np.searchsorted(flat, x), len(flat) - 1)
                present[place[flat[place] == x]] = 1
                both = np.add.reduceat(present[code], start)
                hit = (100 * both >= percent * (len(x) + size - both)) & (labels != own)
                found += [(node, y) for y in nodes[hit]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return cross
