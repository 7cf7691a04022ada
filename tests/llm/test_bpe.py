from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from sitelume.llm.bpe import TIERS, Splitter, decode_documents, default_tokenizer, encode_documents, encode_words, piece_table
from sitelume.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, ids string, key int, gaps int, found int"
ODD = [
    None, "", " \t\r\n\x0b\x0c ", "Don't STOP", "a b c　d \x1c\x1d e\x85f", "é ́x Ȩ́", "ΣΑΣ Σ ΑΣ. İstanbul ǅ ẞ",
    "<|endoftext|>", "a<|startoftext|>B <|ENDOFTEXT|> <|endoftext|><|endoftext|> <|end oftext|>", "日本語のテキスト 🙂👍🏽 \U0001f468‍\U0001f469", "x" * 3000,
    "'s 'T it's we'LL ''ve 1234.5 ³ ½ Ⅷ", "​﻿­", "ﬁ ﷺ ẛ̣", "한국어 한", "\x00\x01\x7f",
]


def reference(text):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("tiers", [TIERS, ((3, 64), (1, 128)), ((0, 64),)])
def test_equals_the_tokenizer(spark, tiers):
    """With all, few and no words broadcast; repeated rows, one id on two texts, a null id."""
    rows = list(enumerate(ODD)) + [(3, ODD[3]), (3, ODD[3]), (4, "another text"), (None, "a b a"), (None, "a b a"), (None, None)]
    got = decode_documents(encode_documents(frame(spark, rows).repartition(3), tiers=tiers)).collect()
    told = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, r.decoded) for r in got]
    want = [(i, *reference(t)) for i, t in rows]
    assert Counter(map(str, told)) == Counter(str((i, ids, len(ids), text)) for i, ids, text in want)


def test_fuzzed_texts_equal_the_tokenizer(spark):
    draw = random.Random(4)
    marks = [*"SsLlmd ÀéßøÖ×÷ªµ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 '.,<|>", "'s", "'LL", "<|endoftext|>", "́", "̧", "Å", "é", "ß", "İ", "Σ", "0", "٣", "字"]
    some = [chr(c) for c in draw.sample([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], 4_000)]
    texts = ["".join(draw.choice(marks if draw.random() < 0.6 else some) for _ in range(draw.randrange(40))) for _ in range(4_000)]
    got = {r.doc_id: r for r in decode_documents(encode_documents(frame(spark, list(enumerate(texts))), tiers=((50, 64),))).collect()}
    tokenizer = Tokenizer.from_file(default_tokenizer())
    for k, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids, repr(text)
        assert got[k].decoded == tokenizer.decode(ids, skip_special_tokens=False), repr(text)


def test_a_sample_changes_no_result(spark, documents):
    whole = {(r.doc_id, bytes(r.ids)) for r in encode_documents(documents).collect()}
    assert {(r.doc_id, bytes(r.ids)) for r in encode_documents(documents, sample=20_000).collect()} == whole


def test_words_have_the_ids_of_their_text():
    tokenizer = Tokenizer.from_file(default_tokenizer())
    encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    for text in filter(None, ODD):
        words = Splitter(default_tokenizer()).words(text)
        assert [i for w in words for i in encode(w)] == encode(text), repr(text)


def test_table_of_words(spark):
    rows = [("the", 3), ("the", 4), ("It's", 1), ("", 1), ("", 2), ("the", 5)]
    got = encode_words(spark.createDataFrame(rows, "word string, n long").coalesce(1), default_tokenizer()).collect()
    assert [(r.word, r.n, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == [(w, n, reference(w)[0]) for w, n in rows]


def test_runs_of_a_word_across_batches(spark):
    rows = [("w" * 50, n) for n in range(9)] + [("the", n) for n in range(90)] + [("a", 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    got = encode_words(spark.createDataFrame(rows, "word string, n long").coalesce(1), default_tokenizer()).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.word, r.n, np.frombuffer(r.ids, "<u4").tolist()) for r in got] == [(w, n, reference(w)[0]) for w, n in rows]


def test_very_long_texts_and_words(spark):
    rows = [(1, "word " * 400_000), (2, "ab" * 200_000), (3, "\n" * 1_000_000), (4, "ab" * 200_000 + " tail")]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encode_documents(frame(spark, rows)).collect()}
    for i, text in rows:
        assert got[i] == reference(text)[0]


def test_no_documents(spark):
    assert decode_documents(encode_documents(frame(spark, []))).collect() == []


def test_piece_table_has_the_vocabulary(spark):
    assert piece_table(spark).where("piece = 'the</w>' OR piece = '<|endoftext|>' AND id = 49407").count() == 2


def test_query_equals_the_tokenizer(spark, data, documents):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = set()
    for r in documents.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in QUERIES["op12_word_table_bpe"](spark, data).collect()]
    assert len(got) == len(want) and set(got) == want
