"""Keyed streams against the batch operators over the same rows, across restarts at a checkpoint."""

from __future__ import annotations

import json
import os
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_state import BEGIN, events

from sitelume.operators import state as batch
from sitelume.streaming import pages
from sitelume.streaming import state as stream

KINDS = {
    "limiter": (
        lambda df: batch.sliding_limiter(df, "key", 3, 40_000_000),
        lambda df: stream.limiter(df, "key", 3, 40_000_000, "10 days"),
    ),
    "buckets": (lambda df: batch.bucket_limiter(df), lambda df: stream.bucket_limiter(df, "10 days")),
    "rotations": (lambda df: batch.rotations(df, "key"), lambda df: stream.rotations(df, "key", 10**12, "10 days")),
}


def written(spark, rows, path):
    """Rows in time order as three files; a status and a bucket for each."""
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq int, kind string")
    status = F.when(F.col("kind") == "error", 403).when(F.col("kind") == "view", 404).otherwise(200)
    bucket = F.element_at(F.array(*[F.lit(b) for b in batch.BUCKETS]), (F.col("seq") % 3 + 1).cast("int"))
    df = df.withColumns({"status": status, "bucket": bucket}).orderBy("ts", "seq").coalesce(1)
    n = len(rows)
    for k in range(3):
        some = df.collect()[k * n // 3 : (k + 1) * n // 3]
        spark.createDataFrame(some, df.schema).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return df


@pytest.mark.parametrize("name", KINDS)
def test_stream_equals_batch_after_restarts(spark, tmp_path, name):
    """The query is stopped and started again for each part of the input."""
    in_batch, in_stream = KINDS[name]
    df = written(spark, events(900, 11, 400_000), f"{tmp_path}/all")
    for k in range(3):
        spark.read.parquet(f"{tmp_path}/all/{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = stream.run_once(in_stream(stream.read_stream(spark, f"{tmp_path}/in", df.schema)), "append", f"file://{tmp_path}/run")
    columns = got.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, in_batch(df).select(*columns).collect()))
    assert got.count() == 900


def test_streaks_after_restarts(spark, tmp_path):
    df = written(spark, events(900, 12, 400_000), f"{tmp_path}/all")
    bad = F.col("kind") == "error"
    for k in range(3):
        spark.read.parquet(f"{tmp_path}/all/{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        told = stream.streak_alerts(stream.read_stream(spark, f"{tmp_path}/in", df.schema), "key", bad, 3, 10**12, "10 days")
        got = stream.run_once(told, "append", f"file://{tmp_path}/run")
    want = batch.alerts(df, "key", ["ts", "seq"], bad).where("failures = 3").select("key", "ts")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_quiet_keys_are_forgotten(spark, tmp_path):
    """Two refused hits of a key, an hour after its window, and another key's hit that moves the watermark in between."""
    rows = [("a", 0), ("a", 1), ("z", 50_000), ("z", 50_001), ("a", 50_002)]
    schema = "key string, ts timestamp, seq int"
    for seq, (key, s) in enumerate(rows):
        one = spark.createDataFrame([(key, BEGIN + timedelta(seconds=s), seq)], schema)
        one.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        told = stream.limiter(stream.read_stream(spark, f"{tmp_path}/in", one.schema), "key", 1, 40_000_000, "1 second")
        got = stream.run_once(told, "append", f"file://{tmp_path}/run")
    # the limiter's state of a went after 40,000 s and an hour, so its last hit is admitted by the window too
    assert {r.seq: r.is_admitted for r in got.collect()} == {0: True, 1: False, 2: True, 3: False, 4: True}


def page_line(url, day, links=()):
    return json.dumps({"url": url, "timestamp": f"2024-01-{day:02d}T00:00:00.000Z", "content_id": f"{url}{day}", "links": {"internal": [{"href": h} for h in links]}})


def test_page_stream_keeps_unreadable_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text(page_line("a", 1) + '\n{"url": "b", broken\n\nnothing\n')
    got = stream.run_once(pages.read_page_stream(spark, f"{tmp_path}/in").select("url", "unreadable"), "append", f"file://{tmp_path}/run")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", None), ("b", '{"url": "b", broken'), (None, "nothing")], key=str)


def test_frontier_of_a_stream_gives_each_url_once_after_a_failure(spark, tmp_path):
    """The sink fails after its second batch is written; the run that follows writes that batch again, in its place."""
    (tmp_path / "in").mkdir()
    for day, links in enumerate((["x", "y", "done"], ["y", "z"], ["x", "v", "v"]), 1):
        (tmp_path / f"in/{day}.jsonl").write_text(page_line(f"p{day}", day, links) + "\n")
        os.utime(tmp_path / f"in/{day}.jsonl", (1_700_000_000 + day, 1_700_000_000 + day))
    index = spark.createDataFrame([("done", "completed"), ("z", "failed")], "url string, status string")
    found = pages.new_urls(pages.linked_urls(pages.read_page_stream(spark, f"{tmp_path}/in", files=1)), index, late="30 days")
    failing = [True]

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        if number == 1 and failing:
            failing.clear()
            raise RuntimeError("lost")

    for _ in range(2):
        query = found.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        if failing:
            with pytest.raises(StreamingQueryException):
                query.awaitTermination()
        else:
            query.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["v", "x", "y", "z"]


def test_changes_against_the_stored_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text("\n".join([page_line("a", 1), page_line("b", 1), page_line("c", 1), "bad"]))
    index = spark.createDataFrame([("a", "a1"), ("b", "b0")], "url string, content_id string")
    got = stream.run_once(pages.changes(pages.read_page_stream(spark, f"{tmp_path}/in"), index), "append", f"file://{tmp_path}/run")
    assert {r.url: r["class"] for r in got.collect()} == {"a": "unchanged", "b": "modified", "c": "new"}


def test_seen_counts_end_at_the_counts(spark, tmp_path):
    rows = [(r[0] or "none", r[1], r[2]) for r in events(300, 9, 400_000)]
    df = spark.createDataFrame(rows, "url string, ts timestamp, seq int")
    for k in range(3):
        df.where(f"seq % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        seen = pages.seen_counts(stream.read_stream(spark, f"{tmp_path}/in", df.schema), 10**12, "30 days")
        got = stream.run_once(seen, "append", f"file://{tmp_path}/run").collect()
    assert {u: max(r.crawl_count for r in got if r.url == u) for u in {r.url for r in got}} == dict(Counter(r[0] for r in rows))
    assert Counter(r.url for r in got if r.is_first) == dict.fromkeys({r[0] for r in rows}, 1)


def test_rows_of_a_key_are_held_as_numbers():
    """All rows that come of a key are held until its last one is read: they are few, of arrays."""

    class Value:
        def get(self):
            return None

        def update(self, value):
            pass

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def getMapState(self, name, key, value):
            return type("Map", (), {"updateValue": lambda *a: None, "removeKey": lambda *a: None})()

        def registerTimer(self, at):
            pass

    n = 25_000
    state = stream.LimiterState(["key"], lambda _: (1, 10), 10)
    state.init(Handle())
    rows = (Row(key="a", ms=ms, seq=None if ms == 5 else ms) for ms in reversed(range(n)))
    told = list(state.handleInputRows(("a",), rows, type("Times", (), {"getCurrentWatermarkInMs": lambda self: 0})()))
    assert len(told) <= -(-n // stream.PART_ROWS)
    assert [ms for r in told for ms in r.ms] == list(range(n))
    assert [seq for r in told for seq in r.seq] == [None if ms == 5 else ms for ms in range(n)]
    assert [free for r in told for free in r.is_admitted] == [ms % 10 == 0 for ms in range(n)]
