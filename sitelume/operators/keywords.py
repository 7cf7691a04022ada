"""Keyword positions of two search engines: parsing, summary, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelume.functions import text as t

#: Columns of the export, in their order.
COLUMNS = (
    "rank", "keyword", "last_checked", "volume_seznam", "volume_google", "position_google", "change_google",
    "position_seznam", "change_seznam", "url_google", "url_seznam", "star", "tag",
)


def position(raw: Column) -> Column:
    """Null for an empty value and for one beyond the list (60+)."""
    return F.when(F.trim(raw) == "60+", None).otherwise(t.int_prefix(raw))


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rows of tab-separated lines without the header; short ones and blank keywords are dropped."""
    cells = lines.select(F.split(value, "\t").alias("c")).where(F.size("c") >= len(COLUMNS))
    cell = {name: F.trim(F.col("c")[k]) for k, name in enumerate(COLUMNS)}
    out = cells.select(
        cell["keyword"].alias("keyword"),
        cell["last_checked"].alias("last_checked"),
        F.coalesce(t.int_prefix(cell["volume_google"]), F.lit(0)).alias("volume_google"),
        F.coalesce(t.int_prefix(cell["volume_seznam"]), F.lit(0)).alias("volume_seznam"),
        *[position(cell[f"position_{e}"]).alias(f"position_{e}") for e in ("google", "seznam")],
        *[t.int_prefix(cell[f"change_{e}"]).alias(f"change_{e}") for e in ("google", "seznam")],
        cell["url_google"].alias("url_google"),
        cell["url_seznam"].alias("url_seznam"),
        cell["tag"].alias("tag"),
    )
    return out.where("keyword <> ''")


def by_position(keywords: DataFrame, engine: str) -> DataFrame:
    """Keywords with their place in the order of an engine's positions, unranked ones last.

    Keywords are counted by position and first letters, and numbered within
    these, so no task sorts the whole export.
    """
    cell = ["_position", "_head"]
    told = keywords.withColumns({"_position": F.coalesce(f"position_{engine}", F.lit(61)), "_head": F.substring("keyword", 1, 3)})
    before = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    starts = told.groupBy(*cell).agg(F.count("*").alias("_n")).select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("keyword"))
    return told.withColumn("_place", inside).join(starts, cell).select(*keywords.columns, (F.col("_start") + F.col("_place")).cast("int").alias("place"))


def summary(keywords: DataFrame) -> DataFrame:
    return keywords.agg(
        F.count("*").alias("total"),
        *[F.round(F.avg(f"position_{e}"), 1).alias(f"avg_{e}") for e in ("google", "seznam")],
        *[F.count_if(F.col(f"position_{e}") <= 10).alias(f"top10_{e}") for e in ("google", "seznam")],
        *[F.count_if(F.col(f"position_{e}").isNull()).alias(f"unranked_{e}") for e in ("google", "seznam")],
    )


def by_tag(keywords: DataFrame) -> DataFrame:
    tag = F.coalesce(F.nullif(F.col("tag"), F.lit("")), F.lit("uncategorized"))
    return keywords.groupBy(tag.alias("tag")).agg(
        F.count("*").alias("keywords"),
        *[F.round(F.avg(f"position_{e}"), 1).alias(f"avg_{e}") for e in ("google", "seznam")],
    )


def top_changes(keywords: DataFrame, engine: str, k: int = 5) -> DataFrame:
    """The k largest improvements and declines, ties by position (unranked last), then keyword."""
    change, place = F.col(f"change_{engine}"), F.coalesce(f"position_{engine}", F.lit(61))
    told = keywords.select("keyword", change.alias("change"), place.alias("position"))
    up = told.where("change > 0").orderBy(F.desc("change"), "position", "keyword").limit(k)
    down = told.where("change < 0").orderBy("change", "position", "keyword").limit(k)
    return up.withColumn("direction", F.lit("up")).unionByName(down.withColumn("direction", F.lit("down")))
