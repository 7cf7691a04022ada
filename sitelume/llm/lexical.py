"""Ranked lexical search by inverted treaps."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import numbered, running
from .scratch import Scratch, only

#: Terms of the items that tasks search for at once; more items are searched block by block.
BLOCK_TERMS = 500_000
#: Documents, and postings of them, whose treaps a task holds at once.
BLOCK_DOCS, BLOCK_POSTINGS = 8_192, 2_000_000
#: One document in so many is searched first, for scores that the best ones reach at least.
SAMPLE = 16
#: Bits of the filter that says which terms no item has (8 MB), and how many of them a term sets.
FILTER_BITS, FILTER_HASHES = 1 << 26, 4
#: Terms that a task remembers the filter's answer for; numbers of a frontier that are looked at together.
REMEMBERED, FRONTIER = 200_000, 4_000_000

#: Bytes of terms as they are, A-Z in lower case; all others separate terms.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The `k` documents of highest score for each item: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of all other characters
    beyond ASCII; A-Z count as lower case. A document's score sums, over the
    item's distinct terms, w * ((10**9 * tf) div (1000 * tf + 8 * m)), with
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 10 + 90 * n * N div L.
    Only scores above 0 count; ties go to the smaller doc_id.

    Documents become postings of the items' terms (a filter of fixed size drops
    the others where texts are read). A task turns its postings, a block of
    documents at a time, into a treap for each term: a search tree by document,
    a heap by impact. It walks the treaps of an item's terms together, by
    ranges of documents, and leaves a range whose summed maxima are below the
    item's k-th score so far. Items are broadcast in blocks of bounded size;
    what they score in a sample of documents comes first, so that no task
    begins without a bound.

    Null texts and texts without terms are no documents and items without
    terms have no rows. Equal rows of items are one item; equal rows of
    documents rank each by itself. A null doc_id ranks after others of its
    score. Empty tables: no rows. Extra columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    asked = only(items, item_id=item_col, text=item_text_col).distinct()
    kind = asked.schema["item_id"].dataType.simpleString()
    asked = asked.mapInArrow(_terms_of("item_id"), f"item_id {kind}, n long, terms array<binary>, tfs array<long>").where("n > 0")
    asked = scratch.keep(asked.select(F.monotonically_increasing_id().alias("item"), "item_id", "terms"))
    words = asked.select("item", F.explode("terms").alias("term"))

    maybe = spark.sparkContext.broadcast(_term_filter(words.select("term").distinct()))
    doc_kind = docs.schema[doc_col].dataType.simpleString()
    posted = only(docs, doc_id=doc_col, text=text_col).mapInArrow(_terms_of("doc_id", maybe), f"doc_id {doc_kind}, n long, terms array<binary>, tfs array<long>")
    posted = scratch.keep(posted.where("n > 0"))
    n_docs, n_terms = posted.agg(F.count("*"), F.sum("n")).first()
    empty = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score long")
    if not n_docs:
        return empty

    df = posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighted = words.join(df.select("term", weight.alias("w")), "term").groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    weighted = scratch.keep(weighted.withColumn("size", F.size("terms")))
    placed = running(numbered(weighted, [F.col("item")], "place", scratch), "size", "place", "before", width=4096)
    placed = scratch.keep(placed.select("item", "terms", F.floor(F.col("before") / BLOCK_TERMS).alias("block")))
    last = placed.agg(F.max("block")).first()[0]
    if last is None:
        return empty

    some = posted.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(SAMPLE)) == 0)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    schema = f"item long, doc_id {doc_kind}, score long"
    found = []
    for block in range(last + 1):  # one for each BLOCK_TERMS terms of the items
        own = _Items.of(placed.where(F.col("block") == block).toArrow())
        first = some.mapInArrow(_searcher(spark.sparkContext.broadcast(own), n_docs, n_terms, k), schema)
        kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("item", "score").toArrow()
        own = own.with_floors(kth["item"].to_numpy(), kth["score"].to_numpy())
        part = posted.mapInArrow(_searcher(spark.sparkContext.broadcast(own), n_docs, n_terms, k), schema)
        found.append(scratch.keep(part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _terms_of(id_name: str, maybe: Broadcast | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to the number of their terms, and their distinct terms (those that `maybe` does not exclude) with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Wanted(maybe.value).__getitem__ if maybe else None
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch["text"].cast(pa.binary()):
                found = (text.as_py() or b"").translate(_BYTES).split()
                counts = Counter(found)
                own = list(filter(wanted, counts)) if maybe else list(counts)
                sizes.append(len(found))
                terms.append(own)
                tfs.append([counts[t] for t in own])
            columns = [batch[id_name], pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.binary())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [id_name, "n", "terms", "tfs"])

    return run


def _term_filter(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of the terms as 64-bit words; its size is fixed, so it passes more terms where there are very many."""
    h = F.xxhash64("term")
    low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)
    places = F.array(*[(low + j * high).bitwiseAND(FILTER_BITS - 1) for j in range(FILTER_HASHES)])
    bits = terms.select(F.explode(places).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit"))
    rows = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


class _Wanted(dict):
    """Term to whether the filter passes it; remembers some answers."""

    def __init__(self, words: np.ndarray):
        super().__init__()
        self.bits = memoryview(np.ascontiguousarray(words).view(np.uint8))

    def __missing__(self, term: bytes) -> bool:
        h = xxhash.xxh64_intdigest(term, 42)  # Spark's xxhash64
        low, high = h & 0xFFFFFFFF, h >> 32
        places = [(low + j * high) & (FILTER_BITS - 1) for j in range(FILTER_HASHES)]
        passes = all(self.bits[at >> 3] >> (at & 7) & 1 for at in places)
        if len(self) >= REMEMBERED:
            self.clear()
        self[term] = passes
        return passes


class _Items(NamedTuple):
    """A block of items: their distinct terms, and for each item places in these with weights."""

    items: np.ndarray
    floors: np.ndarray
    terms: pa.Array
    starts: np.ndarray
    places: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> _Items:
        lists = table["terms"].combine_chunks()
        flat = lists.flatten()
        told = flat.field("term").dictionary_encode()
        starts = np.cumsum([0, *pc.list_value_length(lists).to_numpy(zero_copy_only=False)])
        items = table["item"].to_numpy()
        return cls(items, np.zeros(len(items), np.int64), told.dictionary, starts, told.indices.to_numpy(), flat.field("w").to_numpy())

    def with_floors(self, items: np.ndarray, scores: np.ndarray) -> _Items:
        floor = dict(zip(items.tolist(), scores.tolist(), strict=True))
        return self._replace(floors=np.array([floor.get(i, 0) for i in self.items.tolist()], np.int64))


class Treaps(NamedTuple):
    """The treaps of a block of documents, one for each term: a node is a posting, with the places of its children (-1: none)."""

    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray


def build_treaps(term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int) -> Treaps:
    """Treaps of postings sorted by term and document; equal impacts are heaped by a hash of the document, so that no treap is a chain."""
    mixed = (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    rank = ((impact.astype(np.int64) << 20) + mixed.astype(np.int64)).tolist()
    left, right = [-1] * len(rank), [-1] * len(rank)
    roots = np.full(n_terms, -1)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(rank)], strict=True):
        spine: list[int] = []  # the right edge of the tree so far
        for i in range(start, end):
            below, own = -1, rank[i]
            while spine and rank[spine[-1]] < own:
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
        roots[term[start]] = spine[0]
    return Treaps(doc, impact, np.array(left, np.int64), np.array(right, np.int64), roots)


def walk(treaps: Treaps, terms: np.ndarray, weights: np.ndarray, n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents (places in the block) and scores of the k best with a score of `floor` and above 0, and how many were scored.

    A state is a range of documents with the highest node of each term in it.
    The sum of their impacts bounds every score of the range. The document of
    the node that adds most is scored and splits the range.
    """
    roots = treaps.roots[terms]
    weights, roots = weights[roots >= 0], roots[roots >= 0]
    best, score_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
    kth, scored = max(int(floor), 1), 0
    if not len(roots):
        return best, score_of, scored
    most = max(1, FRONTIER // len(roots))
    doc, impact = treaps.doc, treaps.impact

    def gains(node: np.ndarray) -> np.ndarray:
        return np.where(node >= 0, impact[node] * weights, 0)

    def highest(node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The highest node at or below `node` whose document is in the range."""
        while True:
            at = doc[node]
            before, after = (node >= 0) & (at < low[:, None]), (node >= 0) & (at >= high[:, None])
            if not (before.any() or after.any()):
                return node
            node = np.where(before, treaps.right[node], np.where(after, treaps.left[node], node))

    open_ranges = [(roots[None, :], np.array([0]), np.array([n_docs]))]
    while open_ranges:
        node, low, high = open_ranges.pop()
        bound = gains(node).sum(axis=1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] >= kth]  # an equal score may still win by its document
        if not len(order):
            continue
        if len(order) > most:
            open_ranges.append((node[order[most:]], low[order[most:]], high[order[most:]]))
        node, low, high = node[order[:most]], low[order[:most]], high[order[:most]]
        lead = gains(node).argmax(axis=1)
        at = doc[node[np.arange(len(node)), lead]]
        total = gains(highest(node, at, at + 1)).sum(axis=1)
        scored += len(at)
        good = total >= kth
        best, score_of = np.append(best, at[good]), np.append(score_of, total[good])
        top = np.lexsort((best, -score_of))[:k]
        best, score_of = best[top], score_of[top]
        if len(best) == k:
            kth = max(kth, int(score_of[-1]))
        low, high = np.concatenate([low, at + 1]), np.concatenate([at, high])
        some = low < high
        node = highest(np.concatenate([node, node])[some], low[some], high[some])
        open_ranges.append((node, low[some], high[some]))
    return best, score_of, scored


def _searcher(shared: Broadcast, n_docs: int, n_terms: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best of a task's documents for each item of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: _Items = shared.value
        floors = items.floors.copy()
        best: list[list[tuple]] = [[] for _ in floors]
        kind = pa.int64()
        for ids, lengths, doc, term, tf in _blocks(batches, items.terms):
            kind = ids.type
            m = np.array([10 + 90 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
            order = np.lexsort((doc, term))
            treaps = build_treaps(term[order], doc[order], impact[order], len(items.terms))
            for i, (a, b) in enumerate(zip(items.starts, items.starts[1:], strict=False)):
                at, score, _ = walk(treaps, items.places[a:b], items.weights[a:b], len(lengths), k, floors[i])
                if len(at):
                    found = [(-s, x is None, x) for s, x in zip(score.tolist(), ids.take(pa.array(at)).to_pylist(), strict=True)]
                    best[i] = sorted(best[i] + found)[:k]
                    if len(best[i]) == k:
                        floors[i] = max(floors[i], -best[i][-1][0])
        rows = [(item, x, -s) for item, own in zip(items.items.tolist(), best, strict=True) for s, _, x in own]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())]
        if rows:
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of documents in the order of their ids (nulls last): ids, lengths, and the postings' document, term and tf."""
    held: list[pa.Table] = []
    docs = postings = 0

    def block() -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        told = pa.concat_tables(held).sort_by("doc_id").combine_chunks()
        lists = told["terms"].combine_chunks()
        doc = np.repeat(np.arange(len(told)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return told["doc_id"].combine_chunks(), told["n"].to_numpy(), doc, term, told["tfs"].combine_chunks().flatten().to_numpy(zero_copy_only=False)

    for batch in batches:
        place = pc.index_in(batch["terms"].flatten(), value_set=terms)
        own = place.is_valid()
        counts = pc.list_value_length(batch["terms"]).to_numpy(zero_copy_only=False)
        ends = np.cumsum([0, *own.to_numpy(zero_copy_only=False)])[np.cumsum([0, *counts])]  # terms of other items go
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x.filter(own)) for x in (place, batch["tfs"].flatten())]
        table = pa.table({"doc_id": batch["doc_id"], "n": batch["n"], "terms": lists[0], "tfs": lists[1]})
        start = 0
        while start < len(table):
            room = int(np.searchsorted(ends, ends[start] + BLOCK_POSTINGS - postings, "right")) - 1
            end = min(max(room, start + (not docs)), start + BLOCK_DOCS - docs, len(table))
            if end > start:
                held.append(table.slice(start, end - start))
                docs, postings = docs + end - start, postings + int(ends[end] - ends[start])
            if end < len(table):
                yield block()
                held, docs, postings = [], 0, 0
            start = end
    if held:
        yield block()
