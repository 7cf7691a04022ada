from __future__ import annotations

from collections import Counter

import pytest

from sitelume.llm.sharding import fill_table, place, preference


def brute_force(shards, slots):
    """Turns over full preference lists."""
    lists = [[(f + k * s) % slots for k in range(slots)] for f, s in (preference(x, slots) for x in shards)]
    table = {}
    while len(table) < slots:
        for k, order in enumerate(lists):
            free = next((s for s in order if s not in table), None)
            if free is not None:
                table[free] = k
    return [table[s] for s in range(slots)]


def test_table_equals_brute_force():
    shards = [f"s{k}" for k in range(7)]
    assert fill_table(shards, 101) == brute_force(shards, 101)
    counts = Counter(fill_table(shards, 101))
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_slots_move():
    shards = [f"s{k}" for k in range(20)]
    before, after = fill_table(shards, 10_007), fill_table(shards[:-1], 10_007)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 19)
    assert moved < 0.1 * 10_007


@pytest.mark.parametrize(("shards", "slots"), [(["a"], 100), ([], 101), (["a", "a"], 101)])
def test_bad_tables(shards, slots):
    with pytest.raises(ValueError):
        fill_table(shards, slots)


def test_placement(odd, empty):
    rows = place(odd, ["a", "b", "c"], slots=101).collect()
    assert len(rows) == odd.count()
    table = fill_table(["a", "b", "c"], 101)
    assert all(r.shard == "abc"[table[r.slot]] for r in rows)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert place(empty, ["a"], slots=101).collect() == []
    plan = place(odd, ["a"], slots=101)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
