from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from sitelume.llm import mixing
from sitelume.llm.mixing import STEPS, Mix, mix_documents


def source_targets(sizes, weights=(5, 2, 1), cap=3.0):
    """The same targets in plain Python, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), dict.fromkeys(names, 0.0)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in names if s in free and weight[s] * level > cap * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_targets_share_and_cap():
    got = source_targets({"b": 100, "a": 1000, None: 10, "c": 300})
    # weights by code point, null last: a 5, b 2, c 1, null 5; null and then b reach their caps
    assert got[None] == 30
    assert got["b"] == 300
    assert got["a"] == pytest.approx((1410 - 330) * 5 / 6)
    assert got["c"] == pytest.approx((1410 - 330) / 6)
    assert sum(got.values()) == pytest.approx(1410)
    assert source_targets({}) == {}
    assert source_targets({"a": 0}) == {"a": 0.0}


def sources_frame(spark, sizes):
    rows, n = [], 0
    for source, size in sizes.items():
        for at in range(0, max(size, 1), 40):
            rows.append((n, " ".join(f"w{n}" for _ in range(min(40, size - at))), source))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("bytes_", [4_000_000, 0])
def test_targets_of_many_sources_equal_the_plain_ones(spark, monkeypatch, bytes_):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", bytes_)  # 0: sources are joined with salt, as where they are very many
    sizes = {f"s{k:03d}": (k * 37) % 211 for k in range(60)} | {"é": 4_000, "Z": 7, None: 90}
    mix = Mix(sources_frame(spark, sizes), block_words=16, shard_blocks=32)
    want = source_targets(sizes)
    got = {r.source: r for r in mix.sources.collect()}
    assert {s: r.source_size for s, r in got.items()} == sizes
    assert [r.source for r in sorted(got.values(), key=lambda r: r.k)] == sorted((s for s in sizes if s), key=str.encode) + [None]
    assert all(got[s].target == pytest.approx(want[s]) for s in sizes)
    drawn = {r.k: r.n for r in mix.slots().groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert drawn == {r.k: r.draws for r in got.values() if r.draws}


def test_taken_equals_a_plain_count_of_the_slots(spark, documents):
    """`taken` recomputed in plain Python from the streams and the slots."""
    mix = Mix(documents, block_words=32, shard_blocks=64)
    k_of = {r.source: r.k for r in mix.sources.collect()}
    order = {r.row: r for r in mix.sized.collect()}
    taken, start = {}, {}
    for row in sorted(order.values(), key=lambda r: (k_of[r.source], r.order, r.row)):
        start[row.row] = taken.get(k_of[row.source], 0)
        taken[k_of[row.source]] = start[row.row] + row.size
    times = {}
    for r in mix.slots().collect():
        times[r.k, r.block] = times.get((r.k, r.block), 0) + 1
    want = {}
    for row in order.values():
        words = (start[row.row] + n for n in range(row.size))
        want[row.doc_id] = sum(times.get((k_of[row.source], w // 32), 0) for w in words)
    assert {r.doc_id: r.taken for r in mix.documents().collect()} == want


def test_shard_texts_hold_the_words_of_the_mix(documents):
    mix = Mix(documents, carry=("text",), block_words=64, shard_blocks=32)
    rows = mix.shard_texts().collect()
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.words for r in rows)
    assert sum(r.words for r in rows) == mix.documents().agg(F.sum("taken")).first()[0]
    shards = {}
    for shard, k, turn, block in {(r.shard, r.k, r["pass"], r.block) for r in rows}:
        shards[shard] = shards.get(shard, 0) + 1
    assert max(shards.values()) <= 32


def test_copies_do_not_share_a_lane(spark):
    """Repeated rows are spread over the lanes, and reruns agree however they are dealt."""
    rows = [(7, "one two three four", "a")] * 3_000 + [(k, f"own {k} text", "a") for k in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    results = []
    for parts in (2, 5):
        mix = Mix(df.repartition(parts), lane_docs=100)
        results.append(sorted((r.doc_id, r.taken) for r in mix.documents().collect()))
        starts = sorted(r.start for r in mix.placed.collect())
        assert len(set(starts)) == len(rows)
    assert results[0] == results[1]


def test_taken_words(documents):
    rows = mix_documents(documents).collect()
    assert len(rows) == documents.count()
    text = {r.doc_id: (r.text, r.source) for r in documents.collect()}
    taken, target = {}, {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id][0]))
        assert 0 <= r.taken <= 3 * r.size
        taken[text[r.doc_id][1]] = taken.get(text[r.doc_id][1], 0) + r.taken
        target[text[r.doc_id][1]] = r.target
    for source, want in target.items():
        assert abs(taken[source] - want) <= 0.06 * want + 128


def test_reruns_agree(documents):
    a, b = (sorted(mix_documents(documents.repartition(n)).collect()) for n in (3, 7))
    assert a == b


def test_slots_are_a_permutation(documents):
    mix = Mix(documents, block_words=32, shard_blocks=64)
    sources, slots = mix.sources.orderBy("k").collect(), mix.slots().collect()
    for t in sources:
        rows = [r for r in slots if r.k == t.k]
        assert len(rows) == t.draws
        for turn in range(math.ceil(t.draws / t.blocks) if t.blocks else 0):
            blocks = [r.block for r in rows if r["pass"] == turn]
            assert len(blocks) == len(set(blocks)) == min(t.blocks, t.draws - turn * t.blocks)
            assert not blocks or 0 <= min(blocks) <= max(blocks) < t.blocks
    counts = mix.shard_counts().groupBy("shard").agg(F.sum("n").alias("n")).collect()
    total = sum(t.draws for t in sources)
    assert sum(r.n for r in counts) == total
    assert all(r.n <= 64 for r in counts)


def test_texts_are_the_taken_words(documents):
    mix = Mix(documents, carry=("text",), block_words=64)
    taken = {r.doc_id: r.taken for r in mix.documents().collect()}
    words, whole = {}, {r.doc_id: r.text for r in documents.collect()}
    for r in mix.texts().collect():
        found = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        assert len(found) == r.taken
        words[r.doc_id] = words.get(r.doc_id, 0) + len(found)
        original = iter(re.findall(r"[^\x20\x09-\x0D]+", whole[r.doc_id]))
        assert all(any(w == o for o in original) for w in found)  # in order
    assert words == {k: v for k, v in taken.items() if v}


def test_odd_rows(odd, empty):
    rows = mix_documents(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert all(r.taken <= 3 * r.size for r in rows)
    assert mix_documents(empty).collect() == []
    assert Mix(odd, carry=("text", "lang")).texts().where("text IS NULL").count() == 0


def test_steps_are_primes():
    for p in STEPS:
        assert all(p % q for q in range(2, 2000))


def test_no_python_on_executors(documents):
    plan = mix_documents(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
