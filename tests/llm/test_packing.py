from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sitelume.llm.packing import capacities, default_vocabulary, encoder_of, pack, pack_documents


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40), st.sampled_from([8, 64, 256]))
def test_pack_is_a_partition(lengths, capacity):
    pieces = pack(lengths, capacity)
    for doc, n in enumerate(lengths):
        own = sorted((s, m) for d, s, m, _, _ in pieces if d == doc)
        assert [s for s, _ in own] == list(np.cumsum([0] + [m for _, m in own])[:-1])
        assert sum(m for _, m in own) == n
    used = {}
    for _, _, m, sequence, offset in pieces:
        used.setdefault(sequence, []).append((offset, m))
    for spans in used.values():
        spans.sort()
        assert [o for o, _ in spans] == list(np.cumsum([0] + [m for _, m in spans])[:-1])
        total = sum(m for _, m in spans)
        assert total <= capacity and (total == capacity or total & (total - 1) == 0)


def test_costs_are_balanced():
    lengths = list(np.random.default_rng(1).integers(20, 900, 400))
    cost = {}
    for _, _, n, sequence, _ in pack([int(n) for n in lengths], 2048):
        cost[sequence] = cost.get(sequence, 0) + n + n * n / 2048
    full = sorted(cost.values())[15:]
    assert max(full) / min(full) < 1.35


def test_capacities():
    assert capacities(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    assert capacities(0, 2048) == []


TRICKY = ["", " ", "a", "Don't stop", "x" * 5000, "\r\n\t  two  spaces ", "é ü 日本語 🙂👍", "<|endoftext|> ok", "1234567890 3.14", "  odd​spaces", "'S 'll"]


ADDED = "<|endoftext|>"


def test_ids_equal_the_tokenizer(documents):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = encoder_of(default_vocabulary())
    placed = [ADDED, ADDED * 2, f"{ADDED}a", f"a {ADDED}", f"a  {ADDED}  b", f"a{ADDED} {ADDED}\n", ADDED[:-1], f"<{ADDED}>", ADDED.upper()]
    for text in TRICKY + placed + [r.text for r in documents.limit(60).collect()]:
        assert fast.encode(text) == reference.encode(text, add_special_tokens=False).ids


def test_ids_of_fuzzed_texts_equal_the_tokenizer():
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast, draw = encoder_of(default_vocabulary()), random.Random(11)
    parts = [ADDED, "<|", "|>", "endoftext", " ", "  ", "\n", "\t", "a", "The", "'s", "'LL", "12", "é", "日本", "🙂", "-", "\u00a0", "\u200b", "x" * 40]
    texts = ["".join(draw.choices(parts, k=draw.randrange(1, 25))) for _ in range(20_000)]
    assert sum(ADDED in t for t in texts) > 5_000
    for text, want in zip(texts, reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert fast.encode(text) == want.ids


def test_round_trip(documents):
    fast = encoder_of(default_vocabulary())
    rows = pack_documents(documents, with_ids=True).collect()
    text = {r.doc_id: r.text for r in documents.collect()}
    pieces, sequences = {}, {}
    for r in rows:
        assert len(r.ids) == r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert set(pieces) == set(text)
    for doc, parts in pieces.items():
        ids = [i for _, p, _ in sorted(parts) for i in p]
        assert ids == [*fast.encode(text[doc]), 1]
        assert {t for _, _, t in parts} == {len(ids)}
    assert all(n == 2048 or n & (n - 1) == 0 for n in sequences.values())


def plain_pack(lengths, capacity):
    """The same rule as `pack` in plain Python, with sequences searched one by one."""
    out, queue, sequence = [], [], 0
    for doc, n in enumerate(lengths):
        for k in range(n // capacity):
            out.append((doc, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            queue.append([n % capacity, doc, n // capacity * capacity])
    size = capacities(sum(q[0] for q in queue), capacity)
    used, cost = [0] * len(size), [0.0] * len(size)
    while queue:
        queue.sort(key=lambda q: (-q[0], q[1], q[2]))
        n, doc, start = queue.pop(0)
        room = [s - u for s, u in zip(size, used, strict=True)]
        open_ = [k for k in range(len(size)) if room[k] >= n]
        to = min(open_, key=lambda k: (cost[k], k)) if open_ else max(range(len(size)), key=lambda k: (room[k], -k))
        taken = n if open_ else room[to]
        if taken < n:
            queue.append([n - taken, doc, start + taken])
        out.append((doc, start, taken, sequence + to, used[to]))
        used[to] += taken
        cost[to] += taken + taken * taken / 2048
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_pack_equals_a_plain_packer(lengths):
    assert pack(lengths, 2048) == plain_pack(lengths, 2048)


def test_odd_rows(odd, empty):
    rows = pack_documents(odd).collect()
    assert sum(r.start == 0 for r in rows) == odd.count()
    assert sum(r.doc_tokens == 1 for r in rows) == 3
    assert pack_documents(empty).collect() == []


def test_long_white_space_runs_and_added_tokens(spark):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [f"it's {run * 1_000_000}{end}" for run in (" ", "\n") for end in ("a <|endoftext|> 1", "")] + ["hello <|endoftext|> ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = {}
    for r in pack_documents(df, with_ids=True).collect():
        parts.setdefault(r.doc_id, []).append((r.start, r.ids))
    for doc, text in enumerate(texts):
        ids = [i for _, p in sorted(parts[doc]) for i in p]
        assert ids == [*reference.encode(text, add_special_tokens=False).ids, 1]
