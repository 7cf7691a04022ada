"""State of URLs, request limits and failure streaks, folded from event tables."""

from __future__ import annotations

from collections import deque
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import slices

HOUR = 3_600_000
# Named rule sets, as (requests, hours).
PRESETS = {
    "conservative": ((100, 1),),
    "moderate": ((200, 2),),
    "aggressive": ((500, 3),),
    "bulk": ((1000, 5),),
    "tiered": ((120, 1), (300, 3), (600, 5)),
}
# Hits that a key may make, and the window in ms, by kind of request.
BUCKETS = {"crawl-start": (5, HOUR), "crawl-read": (120, HOUR), "email-send": (5, 24 * HOUR)}
# Hours a finished job is kept, lines its log keeps and shows, failures before an alert or a rotation,
# and ms between rotations.
JOB_HOURS, LOG_LINES, SHOWN_LINES, FAILURES, ROTATION_MS = 24, 500, 10, 3, 60_000


def parse_rules(text: str) -> tuple[tuple[int, int], ...]:
    """Rules "N/H[,N/H...]": requests in hours of 1 to 5, or the name of a preset."""
    if text in PRESETS:
        return PRESETS[text]
    rules = []
    for part in text.split(","):
        n, _, hours = part.strip().partition("/")
        if not (n.isdigit() and hours.isdigit() and int(n) > 0 and 1 <= int(hours) <= 5):
            raise ValueError(f"{part!r} is not N/H with 1 to 5 hours")
        rules.append((int(n), int(hours)))
    return tuple(rules)


def fold_url_state(events: DataFrame) -> DataFrame:
    """Last status of each URL from status events (url, ts, seq, status): retries count failures."""
    return events.groupBy("url").agg(
        F.max_by("status", F.struct("ts", "seq")).alias("status"),
        F.count_if(F.col("status") == "failed").alias("retry_count"),
        F.max(F.when(F.col("status").isin("completed", "failed"), F.col("ts"))).alias("processed_at"),
    )


def index_stats(index: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return index.agg(
        F.count("*").alias("total"), n("completed").alias("processed"), n("failed").alias("failed"), n("pending", "processing").alias("pending")
    )


def retryable(index: DataFrame, most: int = 3) -> DataFrame:
    return index.where((F.col("status") == "failed") & (F.col("retry_count") < most))


def search(index: DataFrame, text: str) -> DataFrame:
    """Entries whose URL, status or domain (if the index has one) holds `text`, in any case."""
    columns = [c for c in ("url", "status", "domain") if c in index.columns]
    found = [F.coalesce(F.lower(c).contains(text.lower()), F.lit(False)) for c in columns]
    return index.where(reduce(lambda a, b: a | b, found))


def trailing_counts(requests: DataFrame, hours: list[int]) -> DataFrame:
    """Requests in the trailing windows of each request, both ends included: n_<hours>h, and oldest_<hours>h (ms).

    Requests of one millisecond are counted first. A window's count is the
    running sum at its end less the running sum before its start: starts are
    merged with the requests in the order of time, so that each row is read once,
    however many requests a window holds. Running sums are worked out by the
    hour and over a row for each hour; requests without a time have no window.
    """
    told = requests.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    counts = told.where("ms IS NOT NULL").groupBy("ms").agg(F.count("*").alias("n"))
    # h = 0: the request itself; else the start of its window of h hours
    ends = [F.struct((F.col("ms") - h * HOUR).alias("at"), F.lit(h).alias("h"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("own")) for h in hours]
    own = F.struct(F.col("ms").alias("at"), F.lit(0).alias("h"), "n", F.col("ms").alias("own"))
    merged = counts.select("ms", F.inline(F.array(own, *ends))).withColumn("hour", F.floor(F.col("at") / HOUR))
    is_own = F.col("h") == 0
    up = Window.partitionBy("hour").orderBy("at", is_own).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("hour").orderBy(F.desc("at"), is_own.desc()).rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumns({"sum": F.coalesce(F.sum("n").over(up), F.lit(0)), "next": F.min("own").over(down)})
    by_hour = counts.groupBy(F.floor(F.col("ms") / HOUR).alias("hour")).agg(F.sum("n").alias("n"), F.min("ms").alias("first"))
    every = merged.select("hour").distinct().join(by_hour, "hour", "left")  # a row an hour
    before, after = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("hour", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.min("first").over(after).alias("later"))
    merged = merged.join(every, "hour").select("ms", "h", (F.col("start") + F.col("sum")).alias("sum"), F.coalesce("next", "later").alias("next"))
    pick = lambda c, h: F.max(F.when(F.col("h") == h, F.col(c)))
    aggs = [(pick("sum", 0) - pick("sum", h)).alias(f"n_{h}h") for h in hours] + [pick("next", h).alias(f"oldest_{h}h") for h in hours]
    return told.join(merged.groupBy("ms").agg(*aggs), "ms", "left")


def limit_status(requests: DataFrame, rules: tuple[tuple[int, int], ...], now: Column) -> DataFrame:
    """State of each rule (by its place in the list) now: requests in its window, whether it blocks, when it next has room."""
    ms, at = F.unix_millis(F.col("ts").cast("timestamp")), F.unix_millis(now)
    aggs = []
    for k, (_, hours) in enumerate(rules):
        inside = (ms >= at - hours * HOUR) & (ms <= at)
        aggs += [F.count_if(inside).alias(f"n{k}"), F.min(F.when(inside, ms)).alias(f"o{k}")]
    counted = requests.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("rule"),
                F.lit(most).alias("max_requests"),
                F.lit(hours).alias("window_hours"),
                F.col(f"n{k}").alias("current"),
                F.greatest(F.lit(0), F.lit(most) - F.col(f"n{k}")).alias("remaining"),
                (F.col(f"n{k}") >= most).alias("is_blocked"),
                F.coalesce(F.col(f"o{k}") + hours * HOUR, at).alias("next_reset_ms"),
            )
            for k, (most, hours) in enumerate(rules)
        ]
    )
    return counted.select(F.inline(rows))


def limit_summary(status: DataFrame, now: Column) -> DataFrame:
    """One row over the rules of `limit_status`: is_blocked, the last rule that blocks, when a request is allowed again."""
    blocks = F.col("is_blocked")
    last = F.max_by(F.struct("max_requests", "window_hours"), F.when(blocks, F.col("rule")))
    return status.agg(
        F.coalesce(F.bool_or(blocks), F.lit(False)).alias("is_blocked"),
        F.when(F.coalesce(F.bool_or(blocks), F.lit(False)), last).alias("rule"),
        F.greatest(F.unix_millis(now), F.max(F.when(blocks, F.col("next_reset_ms")))).alias("next_allowed_ms"),
    ).select("is_blocked", F.col("rule.max_requests").alias("max_requests"), F.col("rule.window_hours").alias("window_hours"), "next_allowed_ms")


def even_delay_ms(rules: tuple[tuple[int, int], ...], jitter: float = 1.0) -> int:
    """Milliseconds between requests that the strictest rule spreads evenly; `jitter` (0.8 to 1.2) varies them."""
    return round(HOUR / min(most / hours for most, hours in rules) * jitter) if rules else 0


def unexpired(requests: DataFrame, rules: tuple[tuple[int, int], ...], now: Column) -> DataFrame:
    """Requests that a limiter still needs: those of its longest window and one hour more."""
    kept = F.unix_millis(now) - (max(hours for _, hours in rules) + 1) * HOUR
    return requests.where(F.unix_millis(F.col("ts").cast("timestamp")) >= kept)


class Limiter:
    """A sliding limiter of one key: a hit is admitted with fewer than `most` admitted in the window before; others leave no trace."""

    def __init__(self, most: int, window_ms: int, held: list[int] = ()):
        self.most, self.window_ms, self.held = most, window_ms, deque(held)

    def hit(self, now: int) -> bool:
        while self.held and self.held[0] <= now - self.window_ms:
            self.held.popleft()
        free = len(self.held) < self.most
        if free:
            self.held.append(now)
        return free


def admit(times: list[int], most: int, window_ms: int) -> list[bool]:
    limiter = Limiter(most, window_ms)
    return [limiter.hit(now) for now in times]


_ADMITTED = {"is_admitted": ("boolean", pa.bool_())}


def _segments(rows: DataFrame, keys: list[str], cut: Column, last: Column) -> DataFrame:
    """`rows` (keys, ms, seq) with segment, which grows at each row where `cut` holds: there a key's state is that of a new key.

    `cut` may use _last, the last value of `last` in the key's rows before.
    """
    told = slices.last_before(slices.sliced(rows, keys, F.col("ms")), last, ["ms", "seq"], "_last")
    told = slices.running_sum(told, F.when(cut, 1).otherwise(0), ["ms", "seq"], "segment")
    return told.select(*rows.columns, "segment")


def sliding_limiter(requests: DataFrame, key: str, most: int, window_ms: int) -> DataFrame:
    """Requests (key, ts, seq) with is_admitted; keys are independent, and null is one of them. State is at most `most` times.

    A key's requests are split where none came for a whole window, as nothing
    is remembered there, so a key with most rows is many tasks if it ever rests.
    """
    told = requests.select(key, F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "seq").where("ms IS NOT NULL")
    told = _segments(told, [key], F.col("ms") - F.col("_last") >= window_ms, F.col("ms"))
    step = lambda limiter, row: (limiter.hit(row[1]),)
    return slices.fold(told, [key, "segment"], ["ms", "seq"], lambda: Limiter(most, window_ms), step, _ADMITTED).drop("segment")


def bucket_limiter(requests: DataFrame) -> DataFrame:
    """Requests (bucket, key, ts, seq) with is_admitted, each kind under its own limit; mail addresses in lower case.

    A null key and an empty one have limits of their own.
    """
    name = F.when(F.col("bucket") == "email-send", F.lower("key")).otherwise(F.col("key"))
    told = requests.where(F.col("bucket").isin(*BUCKETS)).select("bucket", name.alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "seq")
    window = F.element_at(F.create_map(*[F.lit(x) for bucket, (_, ms) in BUCKETS.items() for x in (bucket, ms)]), F.col("bucket"))
    told = _segments(told.where("ms IS NOT NULL"), ["bucket", "key"], F.col("ms") - F.col("_last") >= window, F.col("ms"))

    def step(state: dict, row: tuple) -> tuple:
        if not state:
            state["limiter"] = Limiter(*BUCKETS[row[0]])
        return (state["limiter"].hit(row[2]),)

    return slices.fold(told, ["bucket", "key", "segment"], ["ms", "seq"], dict, step, _ADMITTED).drop("segment")


class Rotation:
    """Failures of a domain in a row, and whether the user agent rotates: at the third, unless it did a minute ago or less."""

    def __init__(self, run: int = 0, last: int | None = None):
        self.run, self.last = run, last

    def response(self, ms: int, failed: bool, missing: bool) -> tuple[int, bool]:
        self.run = self.run + 1 if failed else 0 if missing else self.run
        turn = failed and self.run >= FAILURES and (self.last is None or ms - self.last > ROTATION_MS)
        told = self.run
        if turn:
            self.run, self.last = 0, ms
        return told, turn


def refused(responses: DataFrame) -> Column:
    """Whether a response counts as refused: status 403, or an error (if there is such a column) that says 403 or blocked."""
    told = F.coalesce(F.col("status") == 403, F.lit(False))
    if "error" in responses.columns:
        told |= F.coalesce(F.col("error").contains("403") | F.col("error").contains("blocked"), F.lit(False))
    return told


def rotations(responses: DataFrame, key: str = "domain") -> DataFrame:
    """Responses (key, ts, seq, status, and error if there is one) with failures (refused since the last 404 or rotation) and is_rotated.

    The third refusal rotates the user agent, unless that happened a minute ago
    or less. A key's responses are split at each 404 that has no refusal in the
    minute before it, as nothing is remembered there. Null is a key like another.
    """
    told = responses.select(
        key, F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "seq", F.coalesce("status", F.lit(0)).alias("status"), refused(responses).alias("_refused")
    ).where("ms IS NOT NULL")
    rests = ~F.col("_refused") & (F.col("status") == 404) & F.coalesce(F.col("ms") - F.col("_last") > ROTATION_MS, F.lit(True))
    told = _segments(told, [key], rests, F.when(F.col("_refused"), F.col("ms")))

    def step(state: Rotation, row: tuple) -> tuple:
        return state.response(row[1], row[4], row[3] == 404)

    added = {"failures": ("int", pa.int32()), "is_rotated": ("boolean", pa.bool_())}
    return slices.fold(told, [key, "segment"], ["ms", "seq"], Rotation, step, added).drop("segment", "_refused")


def kept_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs (job_id, started_at, finished_at) that are not evicted: unfinished, or finished in the last 24 hours."""
    age = F.unix_millis(now) - F.unix_millis(F.col("finished_at").cast("timestamp"))
    return jobs.where(F.coalesce(age <= JOB_HOURS * HOUR, F.lit(True)))


def last_lines(log: DataFrame, n: int = LOG_LINES) -> DataFrame:
    """The last `n` lines of each job's log (job_id, seq, line)."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))
    return log.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def job_status(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Jobs with their status and the last lines of their log joined."""
    shown = last_lines(log, SHOWN_LINES).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    told = jobs.join(shown, "job_id", "left")
    state = F.when(F.col("finished_at").isNull(), "running").otherwise("finished")
    return told.select("job_id", state.alias("status"), F.coalesce(F.array_join("l.line", ""), F.lit("")).alias("last_log"))


def running_jobs(jobs: DataFrame) -> DataFrame:
    """At each start or end of a job, how many are unfinished then: ts, job_id, kind, running.

    Events are summed by hour, then within the hour, so no task holds them all.
    """
    starts = jobs.select(F.col("started_at").alias("ts"), "job_id", F.lit("start").alias("kind"), F.lit(1).alias("n"))
    ends = jobs.where("finished_at IS NOT NULL").select(F.col("finished_at").alias("ts"), "job_id", F.lit("end").alias("kind"), F.lit(-1).alias("n"))
    told = starts.unionByName(ends).withColumn("hour", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / HOUR))
    sums = told.groupBy("hour").agg(F.sum("n").alias("all"))
    before = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)  # a row an hour
    sums = sums.select("hour", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("at_hour"))
    inside = Window.partitionBy("hour").orderBy("ts", "kind", "job_id").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("inside", F.sum("n").over(inside)).join(sums, "hour")
    return told.select("ts", "job_id", "kind", (F.col("at_hour") + F.col("inside")).alias("running"))


def _islands(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Failures with the island (run of failures) of their key that they are in; order[0] is a time."""
    told = slices.sliced(events.withColumn("is_failed", failed), [key], F.unix_millis(F.col(order[0]).cast("timestamp")))
    return slices.running_sum(told, F.when(~F.col("is_failed"), 1).otherwise(0), order, "island").where("is_failed")


def streaks(events: DataFrame, key: str, order: list[str], failed: Column, least: int = FAILURES) -> DataFrame:
    """Runs of `least` or more failures in a row of each key: key, first, last, failures.

    A key's events are worked on by time slices, and a run is added up from its
    parts. Null is a key like another.
    """
    runs = _islands(events, key, order, failed).groupBy(key, "island").agg(
        F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("failures")
    )
    return runs.where(F.col("failures") >= least).drop("island")


def alerts(events: DataFrame, key: str, order: list[str], failed: Column, least: int = FAILURES) -> DataFrame:
    """A row for each failure that is the `least`-th in a row of its key, or a later one: key, ts, failures, message."""
    told = _islands(events, key, order, failed).select(key, *order, "_slice", F.struct(key, "island").alias("_key"))
    told = slices.running_sum(told, F.lit(1), order, "failures").where(F.col("failures") >= least)
    message = F.concat(F.lit('[ALERT] Domain "'), F.col(key).cast("string"), F.lit('" failed '), F.col("failures"), F.lit(" crawls in a row"))
    return told.select(key, order[0], F.col("failures").cast("int").alias("failures"), message.alias("message"))


def frontier(seeds: DataFrame, index: DataFrame) -> DataFrame:
    """URLs to crawl: seeds and unfinished URLs of the index, each once, without the completed ones."""
    unfinished = index.where("status IN ('pending', 'processing')").select("url")
    done = index.where("status = 'completed'").select("url")
    return seeds.select("url").unionByName(unfinished).distinct().join(done, "url", "left_anti")


def alerts_kept(alerts: DataFrame, cutoff: Column) -> DataFrame:
    """Alerts since `cutoff`; those with an unreadable time stay."""
    return alerts.where(F.coalesce(F.col("timestamp").try_cast("timestamp") >= cutoff, F.lit(True)))


def latest_date(records: DataFrame) -> DataFrame:
    """The records of the latest crawl date; all of them where none has a date."""
    latest = records.agg(F.max("crawl_date").alias("latest"))  # one row
    return records.join(F.broadcast(latest), F.col("latest").isNull() | (F.col("crawl_date") == F.col("latest"))).drop("latest")


def latest_file(files: DataFrame, suffix: str = ".md") -> DataFrame:
    """Of each domain the first file of that kind in its latest report that has one: domain, crawl_date, name."""
    found = files.where(F.col("name").endswith(suffix))
    best = found.groupBy("domain").agg(F.min(F.struct(-F.unix_date("crawl_date"), "name", "crawl_date")).alias("b"))
    return best.select("domain", "b.crawl_date", "b.name")


def latest_reports(partitions: DataFrame) -> DataFrame:
    """Crawl dates of each domain (domain, crawl_date): the latest and how many."""
    return partitions.groupBy("domain").agg(F.max("crawl_date").alias("latest"), F.countDistinct("crawl_date").alias("crawls"))

