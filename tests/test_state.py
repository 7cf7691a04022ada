"""The event operators against plain loops over the same rows: null, tied, repeated and hot keys."""

from __future__ import annotations

import random
import time
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitelume.operators import slices, state

BEGIN = datetime(2024, 1, 1)


def events(n=3000, seed=1, span_s=900_000):
    """(key, ts, seq, kind): one key has half of all rows, another is null; times repeat and cluster."""
    draw = random.Random(seed)
    keys = ["hot", "hot", "hot", None, "", "a", "b"]
    rows = []
    for seq in range(n):
        at = draw.choice([draw.randrange(span_s), 3600 * draw.randrange(span_s // 3600), draw.randrange(7200)])
        rows.append((draw.choice(keys), BEGIN + timedelta(seconds=at), seq, draw.choice(["error", "error", "view", "click"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, ts timestamp, seq int, kind string").repartition(4)


def ms_of(ts):
    return int((ts - datetime(1970, 1, 1)).total_seconds() * 1000)


def by_key(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out[r[0]].append(r)
    return out


@pytest.fixture(params=[24 * 3_600_000, 3_600_000])
def slice_ms(request, monkeypatch):
    monkeypatch.setattr(slices, "SLICE_MS", request.param)


@pytest.mark.parametrize("most, window_s", [(3, 60), (5, 3600), (2, 50_000)])
def test_sliding_limiter(spark, slice_ms, most, window_s):
    rows = events()
    got = {(r.key, r.seq): r.is_admitted for r in state.sliding_limiter(frame(spark, rows), "key", most, window_s * 1000).collect()}
    for key, own in by_key(rows).items():
        held = []
        for _, ts, seq, _ in own:
            held = [t for t in held if ms_of(t) > ms_of(ts) - window_s * 1000]
            assert got[key, seq] == (len(held) < most)
            held += [ts] if len(held) < most else []
    assert len(got) == len(rows)


def test_null_keys_of_a_number_are_limited(spark):
    rows = [(None, BEGIN + timedelta(seconds=k), k) for k in range(10)] + [(2**60 + 1, BEGIN + timedelta(seconds=k), 10 + k) for k in range(10)]
    df = spark.createDataFrame(rows, "key long, ts timestamp, seq int")
    got = state.sliding_limiter(df, "key", 3, 3_600_000).where("is_admitted").groupBy("key").count().collect()
    assert {r.key: r["count"] for r in got} == {None: 3, 2**60 + 1: 3}


def test_bucket_limits(spark):
    draw = random.Random(2)
    rows = [(draw.choice([*state.BUCKETS, "other"]), draw.choice(["A@x", "a@X", None, "", "ip"]), BEGIN + timedelta(seconds=draw.randrange(200_000)), seq) for seq in range(2000)]
    got = {r.seq: r.is_admitted for r in state.bucket_limiter(spark.createDataFrame(rows, "bucket string, key string, ts timestamp, seq int")).collect()}
    held = defaultdict(list)
    for bucket, key, ts, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        if bucket == "other":
            assert seq not in got
            continue
        most, window = state.BUCKETS[bucket]
        own = held[bucket, key.lower() if key and bucket == "email-send" else key]
        own[:] = [t for t in own if t > ms_of(ts) - window]
        assert got[seq] == (len(own) < most)
        own += [ms_of(ts)] if len(own) < most else []


def test_rotations(spark, slice_ms):
    rows = [(k, ts, seq, {"error": 403, "view": 404, "click": 200}[kind]) for k, ts, seq, kind in events(4000, 3, 20_000)]
    got = {r.seq: (r.failures, r.is_rotated) for r in state.rotations(spark.createDataFrame(rows, "domain string, ts timestamp, seq int, status int")).collect()}
    turns = 0
    for own in by_key(rows).values():
        run, last = 0, None
        for _, ts, seq, status in own:
            run = run + 1 if status == 403 else 0 if status == 404 else run
            turn = status == 403 and run >= 3 and (last is None or ms_of(ts) - last > 60_000)
            assert got[seq] == (run, turn)
            run, last, turns = (0, ms_of(ts), turns + 1) if turn else (run, last, turns)
    assert turns > 20


def test_streaks_and_alerts(spark, slice_ms):
    rows = events(4000, 5)
    df = frame(spark, rows)
    bad = F.col("kind") == "error"
    runs, told = [], []
    for key, own in by_key(rows).items():
        run = []
        for r in [*own, (key, None, None, "end")]:
            if r[3] == "error":
                run.append(r[1])
                told += [(key, r[1], len(run))] if len(run) >= 3 else []
            else:
                runs += [(key, run[0], run[-1], len(run))] if len(run) >= 3 else []
                run = []
    got = [(r.key, r["first"], r["last"], r.failures) for r in state.streaks(df, "key", ["ts", "seq"], bad).collect()]
    assert sorted(map(str, got)) == sorted(map(str, runs)) and len(runs) > 50
    got = [(r.key, r.ts, r.failures) for r in state.alerts(df, "key", ["ts", "seq"], bad).collect()]
    assert sorted(map(str, got)) == sorted(map(str, told))


def test_one_hot_key_is_many_tasks(spark):
    """No task of the window over a key that has all rows holds more than a slice of them."""
    df = spark.range(40_000).select(F.lit("hot").alias("key"), (F.timestamp_seconds(F.col("id") * 600)).alias("ts"), F.col("id").alias("seq"), (F.col("id") % 7 != 0).alias("bad"))
    told = state._islands(df, "key", ["ts", "seq"], F.col("bad")).select(F.spark_partition_id().alias("p")).groupBy("p").count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in told.collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


def test_trailing_counts(spark):
    rows = events(3000, 7, 60_000) + [("late", BEGIN + timedelta(days=40), 9000, "view"), ("none", None, 9001, "view")]
    got = {r.seq: r for r in state.trailing_counts(frame(spark, rows), [1, 5]).collect()}
    times = sorted(ms_of(r[1]) for r in rows if r[1])
    for _, ts, seq, _ in rows:
        for hours in (1, 5):
            inside = [t for t in times if ts and ms_of(ts) - hours * state.HOUR <= t <= ms_of(ts)]
            assert (got[seq][f"n_{hours}h"], got[seq][f"oldest_{hours}h"]) == ((len(inside), inside[0]) if ts else (None, None))


def test_trailing_counts_take_time_by_their_number(spark):
    """A million requests within one window, one a millisecond."""

    def run(n):
        df = spark.range(n).select(F.timestamp_millis(F.col("id") + 1_700_000_000_000).alias("ts"))
        began = time.perf_counter()
        top = state.trailing_counts(df, [1]).agg(F.max("n_1h"), F.min("n_1h"), F.count("*")).first()
        assert tuple(top) == (n, 1, n)
        return time.perf_counter() - began

    run(1000)
    small, large = run(125_000), run(1_000_000)
    assert large < 16 * small


def test_the_last_rule_that_blocks_is_told(spark):
    df = spark.createDataFrame([(BEGIN + timedelta(minutes=m),) for m in range(30)], "ts timestamp")
    now = F.lit(BEGIN + timedelta(minutes=30)).cast("timestamp")
    told = state.limit_summary(state.limit_status(df, ((5, 5), (2, 1), (100, 3)), now), now).first()
    assert (told.is_blocked, told.max_requests, told.window_hours) == (True, 2, 1)
    told = state.limit_summary(state.limit_status(df, ((500, 5),), now), now).first()
    assert (told.is_blocked, told.max_requests, told.next_allowed_ms) == (False, None, ms_of(BEGIN + timedelta(minutes=30)))
