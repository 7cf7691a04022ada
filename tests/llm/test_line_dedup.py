from __future__ import annotations

import random
import re

import pytest
from parity import assert_same, connect

from sitelume.llm import line_dedup, queries
from sitelume.llm.line_dedup import dedup_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, least=50):
    """Lines to delete, by comparing every pair of starting lines in plain Python."""
    docs = []
    for doc, text in rows:
        lines = text.split("\n")
        docs.append((doc, [(p, line, len(WORD.findall(line))) for p, line in enumerate(lines) if WORD.search(line)], lines))
    places = [(d, i) for d, (_, seq, _) in enumerate(docs) for i in range(len(seq))]
    gone = {doc: set() for doc, _, _ in docs}
    for later in range(len(places)):
        d, i = places[later]
        for e, j in places[:later]:
            n = words = 0
            x, y = docs[d][1], docs[e][1]
            while i + n < len(x) and j + n < len(y) and x[i + n][1] == y[j + n][1]:
                words += x[i + n][2]
                n += 1
            if words >= least:
                # every window of the run that has words enough, apart from what overlaps its own first copy
                for a in range(n):
                    total = 0
                    for b in range(a, n):
                        total += x[i + b][2]
                        if total >= least:
                            first = max(i + a, j + b + 1) if d == e else i + a
                            gone[docs[d][0]].update(x[k][0] for k in range(first, i + b + 1))
                            break
                for b in range(n):
                    total = 0
                    for a in range(b, -1, -1):
                        total += x[i + a][2]
                        if total >= least:
                            first = max(i + a, j + b + 1) if d == e else i + a
                            gone[docs[d][0]].update(x[k][0] for k in range(first, i + b + 1))
                            break
    return {doc: "\n".join(line for p, line in enumerate(lines) if p not in gone[doc]) for doc, _, lines in docs}


def test_query_equals_its_oracle(spark, data):
    assert_same(queries.op4_line_dedup(spark, data), connect(data), queries.ORACLE_SQL["op4_line_dedup"])


def test_distinct_documents_equal_brute_force(spark):
    random.seed(4)
    pool = [" ".join(f"w{random.randrange(50)}" for _ in range(random.choice((3, 12, 30)))) for _ in range(9)]
    rows = []
    for k in range(14):
        lines = [f"only {k} {n}" for n in range(4)]
        at = random.randrange(5)
        start = random.randrange(5)
        lines[at:at] = pool[start : start + random.randrange(2, 5)]
        rows.append((k, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(df).collect()} == brute_force(rows)


@pytest.mark.parametrize(("range_", "hot"), [(2, 3), (5, 256)])
def test_small_ranges_and_hot_lines_equal_brute_force(spark, monkeypatch, range_, hot):
    """Intervals over many ranges of the suffix array, and lines that are hot keys."""
    monkeypatch.setattr(line_dedup, "RANGE", range_)
    monkeypatch.setattr(line_dedup, "HOT", hot)
    random.seed(9)
    pool = [" ".join(f"w{random.randrange(50)}" for _ in range(random.choice((1, 4, 9, 26)))) for _ in range(7)] + ["x"]
    rows = []
    for k in range(16):
        lines = []
        while len(lines) < 9:
            start = random.randrange(len(pool))
            lines += pool[start : start + random.randrange(1, 6)] + (["x"] * random.randrange(3)) + ([""] if k % 3 else [])
            lines += [f"only {k} {len(lines)}"] if random.random() < 0.4 else []
        rows.append((k, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    full = lambda text: [line for line in text.split("\n") if line]  # noqa: E731  blank lines go with the runs around them
    got, want = {r.doc_id: full(r.text) for r in dedup_lines(df).collect()}, brute_force(rows)
    assert got == {k: full(text) for k, text in want.items()}
    assert any(got[k] != full(text) for k, text in rows)


def test_repetition_inside_one_text_leaves_a_copy(spark):
    line = " ".join(f"a{k}" for k in range(25))
    df = spark.createDataFrame([(1, "\n".join([line] * 7)), (2, f"x\n\n{line}\n\n{line}\ny")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert got[1] == f"{line}\n{line}"
    assert got[2] == "x\n\ny"


def test_short_repeats_stay(spark):
    df = spark.createDataFrame([(k, f"All rights reserved.\nown {k}") for k in range(30)], "doc_id long, text string")
    assert dedup_lines(df).where("n_removed > 0").count() == 0


def test_odd_rows(odd, empty):
    got = dedup_lines(odd)
    assert got.columns[: len(odd.columns)] == odd.columns
    rows = got.collect()
    assert len(rows) == odd.count()
    assert sum(r.text is None for r in rows) == 2
    assert dedup_lines(empty).count() == 0


def test_copies_are_emptied_and_null_ids_come_last(spark):
    text = " ".join(f"t{k}" for k in range(60))
    rows = [(None, text), (5, text), (5, text), (9, text + "\nmore words here")]
    got = sorted((r.doc_id or 0, r.text, r.emptied) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "", True), (5, text, False), (5, text, False), (9, "more words here", False)]


def test_repeated_rows_of_many_short_lines_are_one_document(spark):
    passage = [" ".join(f"p{k}_{w}" for w in range(10)) for k in range(8)]
    copy = "\n".join(["own", *passage, "end"])
    rows = [(1, "\n".join(passage)), (2, copy), (2, copy), (2, copy), (None, copy), (None, copy)]
    got = sorted((r.doc_id or 0, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "")] * 2 + [(1, "\n".join(passage))] + [(2, "own\nend")] * 3


def test_lines_only_repeated_rows_hold_stay(spark):
    text = "\n".join(" ".join(f"q{k}_{w}" for w in range(30)) for k in range(4))
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r.text for r in dedup_lines(df).collect()] == [text] * 2
