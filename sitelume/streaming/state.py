"""The event operators as Structured Streaming jobs, one for each batch operator of `operators.state`."""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StructType

from sitelume.operators.state import BUCKETS, HOUR, Rotation, refused

#: Rows of a key that are Python objects at a time.
PART_ROWS = 10_000
_NO_SEQ = -(1 << 63)


def read_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files: int = 100) -> DataFrame:
    """New files of a folder as a stream; `files` bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def window_counts(events: DataFrame, hours: int = 3, slide: int = 1, late: str = "1 hour") -> DataFrame:
    """Events in sliding windows, for monitoring a limit; rows later than `late` are dropped."""
    told = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return told.groupBy(F.window("ts", f"{hours} hours", f"{slide} hours")).agg(F.count("*").alias("n")).select(
        F.col("window.start").cast(events.schema["ts"].dataType).alias("start"), "n"
    )


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once while the watermark remembers it."""
    told = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return told.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def fold_status(events: DataFrame) -> DataFrame:
    """Last status and failures of each URL, updated by each micro-batch; state is one row for each URL."""
    return events.groupBy("url").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"),
        F.count_if(F.col("status") == "failed").alias("retry_count"),
    )


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """Keyed state with timers needs the state store that keeps each value by itself on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class KeyState(StatefulProcessor):
    """State of one key that goes by an event-time timer, once the key has been quiet for `ttl_ms`.

    The rows of a key in a micro-batch are read in the order of ms and seq;
    across batches the order of arrival holds. No data frame is made of them:
    their ms, seq and `fields` (type codes by name, O for any object) are kept as
    numbers, and `read` gets parts of PART_ROWS tuples of them.
    """

    fields: dict[str, str] = {}

    def __init__(self, names: list[str], ttl_ms: int):
        self.names, self.ttl_ms = names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.open(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        ms, seq = array("q"), array("q")
        others = [[] if code == "O" else array(code) for code in self.fields.values()]
        for r in rows:
            if r.ms is not None:
                ms.append(r.ms)
                seq.append(_NO_SEQ if r.seq is None else r.seq)
                for name, column in zip(self.fields, others, strict=True):
                    column.append(r[name])
        if not ms:
            return
        last = max(ms)
        yield from self.read(key, _parts(ms, seq, others))
        old, at = self.timer.get(), last + self.ttl_ms
        if old is None or at > old[0]:
            if old is not None:
                self.handle.deleteTimer(old[0])
            at = max(at, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


    def packed(self, key: tuple, **columns: list) -> Row:
        """A row of arrays, as all rows that come of a key are held until its last one is read."""
        plain = {name: values if None in values else np.array(values) for name, values in columns.items()}
        return Row(**dict(zip(self.names, key, strict=True)), **plain)


def _parts(ms: array, seq: array, others: list) -> Iterator[list[tuple]]:
    """Rows (ms, seq and the others) in the order of ms and seq, by parts."""
    times, places = np.asarray(ms), np.asarray(seq)
    order = np.lexsort((places, times))
    for start in range(0, len(order), PART_ROWS):
        some = order[start : start + PART_ROWS]
        numbers = [None if s == _NO_SEQ else s for s in places[some].tolist()]
        yield list(zip(times[some].tolist(), numbers, *([column[i] for i in some.tolist()] for column in others), strict=True))


class LimiterState(KeyState):
    """Admitted times of a key: each is a value of its own, written once and removed once; `limit_of` gives the key's limit and window."""

    def __init__(self, names: list[str], limit_of: Callable[[tuple], tuple[int, int]], ttl_ms: int):
        super().__init__(names, ttl_ms)
        self.limit_of = limit_of

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "place long", "ms long")
        self.ends = handle.getValueState("ends", "first long, next long")

    def read(self, key: tuple, parts: Iterator[list[tuple]]) -> Iterator[Row]:
        most, window_ms = self.limit_of(key)
        first, then = self.ends.get() or (0, 0)
        gone, fresh = first, deque()  # places gone to then are stored, and after them come the fresh ones
        head = self.held.getValue((gone,))[0] if gone < then else None
        for part in parts:
            admitted = []
            for ms, _ in part:
                while head is not None and head <= ms - window_ms:
                    gone += 1
                    head = self.held.getValue((gone,))[0] if gone < then else None
                while head is None and fresh and fresh[0] <= ms - window_ms:
                    fresh.popleft()
                admitted.append(then - gone + len(fresh) < most)
                if admitted[-1]:
                    fresh.append(ms)
            times, places = map(list, zip(*part, strict=True))
            yield self.packed(key, ms=times, seq=places, is_admitted=admitted)
        for place in range(first, gone):
            self.held.removeKey((place,))
        for place, ms in enumerate(fresh, then):
            self.held.updateValue((place,), (ms,))
        self.ends.update((gone, then + len(fresh)))

    def forget(self) -> None:
        self.held.clear()
        self.ends.clear()


class StreakState(KeyState):
    """Failures of a key in a row; a row whenever they reach `least`."""

    fields = {"is_failed": "O", "ts": "O"}

    def __init__(self, names: list[str], least: int, ttl_ms: int):
        super().__init__(names, ttl_ms)
        self.least = least

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "n int")

    def read(self, key: tuple, parts: Iterator[list[tuple]]) -> Iterator[Row]:
        n = (self.run.get() or (0,))[0]
        for _, _, is_failed, ts in (row for part in parts for row in part):
            if is_failed is not None:
                n = n + 1 if is_failed else 0
            if is_failed and n == self.least:
                yield Row(**dict(zip(self.names, key, strict=True)), ts=ts)
        self.run.update((n,))

    def forget(self) -> None:
        self.run.clear()


class RotationState(KeyState):
    """A domain's refusals in a row and its last rotation, as `operators.state.Rotation` has them."""

    fields = {"status": "q", "is_refused": "b"}

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.domain = handle.getValueState("domain", "run int, last long")

    def read(self, key: tuple, parts: Iterator[list[tuple]]) -> Iterator[Row]:
        rotation = Rotation(*(self.domain.get() or (0, None)))
        for part in parts:
            told = [rotation.response(ms, bool(is_refused), status == 404) for ms, _, status, is_refused in part]
            times, places, statuses, _ = map(list, zip(*part, strict=True))
            failures, turns = map(list, zip(*told, strict=True))
            yield self.packed(key, ms=times, seq=places, status=statuses, failures=failures, is_rotated=turns)
        self.domain.update((rotation.run, rotation.last))

    def forget(self) -> None:
        self.domain.clear()


def _ms() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")


def _by_key(events: DataFrame, keys: list[str], state: KeyState, out: str) -> DataFrame:
    with_rocksdb(events.sparkSession)
    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    return events.groupBy(*keys).transformWithState(state, f"{kinds}, {out}", "append", "eventTime")


def _rows_by_key(events: DataFrame, keys: list[str], state: KeyState, out: dict[str, str]) -> DataFrame:
    """As `_by_key`, for states that give rows of arrays: a row for each element."""
    told = _by_key(events, keys, state, ", ".join(f"{name} array<{kind}>" for name, kind in out.items()))
    return told.select(*keys, F.inline(F.arrays_zip(*out)))


_ADMITTED = {"ms": "long", "seq": "long", "is_admitted": "boolean"}


def limiter(events: DataFrame, key: str, most: int, window_ms: int, late: str = "1 day") -> DataFrame:
    """Hits with is_admitted, as `operators.state.sliding_limiter`; null is a key like another.

    State is at most `most` times for each key, and goes an hour after its
    window if the key is quiet. Rows later than `late` are dropped.
    """
    told = _timed(events.select(key, "ts", _ms(), "seq"), late)
    return _rows_by_key(told, [key], LimiterState([key], lambda _: (most, window_ms), window_ms + HOUR), _ADMITTED)


def bucket_limiter(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests (bucket, key, ts, seq) with is_admitted, as `operators.state.bucket_limiter`."""
    name = F.when(F.col("bucket") == "email-send", F.lower("key")).otherwise(F.col("key"))
    told = _timed(requests.where(F.col("bucket").isin(*BUCKETS)).select("bucket", name.alias("key"), "ts", _ms(), "seq"), late)
    longest = max(window for _, window in BUCKETS.values())
    state = LimiterState(["bucket", "key"], lambda key: BUCKETS[key[0]], longest + HOUR)
    return _rows_by_key(told, ["bucket", "key"], state, _ADMITTED)


def rotations(responses: DataFrame, key: str = "domain", ttl_ms: int = 24 * HOUR, late: str = "1 day") -> DataFrame:
    """Responses with failures and is_rotated, as `operators.state.rotations`; a domain quiet for `ttl_ms` begins anew."""
    told = responses.select(key, "ts", _ms(), "seq", F.coalesce("status", F.lit(0)).alias("status"), F.coalesce(refused(responses), F.lit(False)).alias("is_refused"))
    out = {"ms": "long", "seq": "long", "status": "int", "failures": "int", "is_rotated": "boolean"}
    return _rows_by_key(_timed(told, late), [key], RotationState([key], ttl_ms), out)


def streak_alerts(events: DataFrame, key: str, failed: Column, least: int = 3, ttl_ms: int = 30 * 24 * HOUR, late: str = "1 day") -> DataFrame:
    """A row whenever a key's failures in a row reach `least` (once for each run).

    State is one number for each key, and goes when a key has been quiet for
    `ttl_ms`. Rows later than `late` are dropped.
    """
    told = _timed(events.select(key, "ts", _ms(), "seq", failed.alias("is_failed")), late)
    kind = events.schema["ts"].dataType.simpleString()
    return _by_key(told, [key], StreakState([key], least, ttl_ms), f"ts {kind}")


def write_alerts(alerts: DataFrame, folder: str, checkpoint: str):
    """Append alerts as JSON lines below `folder`, as they come; a batch that runs again replaces its own file."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/batch={number}")

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def run_once(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Process what is there, stop, and return the result as written below `folder`.

    In append mode each micro-batch adds its rows; in complete mode it replaces
    the result. A batch that runs again after a failure replaces its own files.
    """

    def write(batch: DataFrame, number: int) -> None:
        part = f"{folder}/out/batch={number if mode == 'append' else 0}"
        batch.write.mode("overwrite").parquet(part)

    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    out = stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
    return out.drop("batch")
