"""Page records as a stream: readable and unreadable lines, URLs seen, and what is new against a stored index."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sitelume.sources.schema import PAGE

from .state import HOUR, KeyState, _by_key, _ms, _timed


def read_page_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Page records of new JSON-lines files as a stream, with `unreadable`: the text of a line that is no page record, else null.

    A bad line fails nothing and loses nothing: it is a row whose URL is kept
    where one can be found in it.
    """
    schema = spark.createDataFrame([], f"{PAGE}, unreadable string").schema
    told = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", "unreadable").option("maxFilesPerTrigger", files).json(path)
    found = F.nullif(F.regexp_extract("unreadable", r'"url"\s*:\s*"([^"]+)"', 1), F.lit(""))
    return told.withColumn("url", F.coalesce("url", found))


class SeenState(KeyState):
    """How often a key was seen; a row for each micro-batch that has it."""

    def open(self, handle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def read(self, key: tuple, parts: Iterator[list[tuple]]) -> Iterator[Row]:
        before = (self.seen.get() or (0,))[0]
        now = before + sum(map(len, parts))
        self.seen.update((now,))
        yield Row(**dict(zip(self.names, key, strict=True)), crawl_count=now, is_first=before == 0)

    def forget(self) -> None:
        self.seen.clear()


def seen_counts(visits: DataFrame, ttl_ms: int = 30 * 24 * HOUR, late: str = "1 day") -> DataFrame:
    """Visits (url, ts, seq) to url, crawl_count so far and is_first, whenever a micro-batch changes a URL's count.

    State is one number for each URL, and goes when a URL was not seen for `ttl_ms`.
    """
    told = _timed(visits.where("url IS NOT NULL").select("url", "ts", _ms(), "seq"), late)
    return _by_key(told, ["url"], SeenState(["url"], ttl_ms), "crawl_count long, is_first boolean")


def linked_urls(pages: DataFrame) -> DataFrame:
    """Internal links of streamed page records as visits: url, ts (of the page), seq."""
    rows = pages.where("unreadable IS NULL").select(F.col("timestamp").try_cast("timestamp").alias("ts"), F.posexplode("links.internal").alias("seq", "l"))
    return rows.select(F.col("l.href").alias("url"), "ts", "seq").where("url IS NOT NULL AND ts IS NOT NULL")


def new_urls(visits: DataFrame, index: DataFrame, ttl_ms: int = 30 * 24 * HOUR, late: str = "1 day") -> DataFrame:
    """URLs of a stream of visits the first time each is seen, without those that the stored `index` (url, status) has completed.

    The index is joined as it stands when a micro-batch runs.
    """
    first = seen_counts(visits, ttl_ms, late).where("is_first").select("url")
    return first.join(index.where("status = 'completed'").select("url"), "url", "left_anti")


def changes(pages: DataFrame, index: DataFrame) -> DataFrame:
    """Streamed page records (url, content_id) against the stored index (url, content_id): url and class new, modified or unchanged."""
    stored = index.groupBy("url").agg(F.max("content_id").alias("_stored"), F.lit(True).alias("_is_stored"))
    told = pages.where("unreadable IS NULL AND url IS NOT NULL").select("url", "content_id").join(stored, "url", "left")
    kind = F.when(F.col("_is_stored").isNull(), "new").when(F.col("content_id").eqNullSafe(F.col("_stored")), "unchanged").otherwise("modified")
    return told.select("url", kind.alias("class"))
