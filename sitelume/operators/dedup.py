"""Which record of a URL counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_wins(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row of each key, the last by `order` (nulls first). Rows with a null key are dropped.

    An aggregation and not a window: map-side combine leaves one row of each
    key and task to shuffle, so a URL crawled very often is no hot task.
    """
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("best"))
    return best.select(*keys, "best.*").select(df.columns)


def first_wins(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """One row of each key, the first by `order`."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("best"))
    return best.select(*keys, "best.*").select(df.columns)


def merge_dedup(df: DataFrame, url: str, line: str) -> DataFrame:
    """The last line of each URL; records without a URL all stay."""
    return latest_wins(df, [url], line).unionByName(df.where(F.col(url).isNull()))
