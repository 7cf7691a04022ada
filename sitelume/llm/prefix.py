"""Numbering and running sums of whole tables in two levels, so that no task holds a table or a group of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

_INSIDE = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """`df` with `name`, the row's place (0 on) in the order of `order`.

    The sorted table is written once; a row's number is its place in its
    partition and the rows of the partitions before, of which there are as many
    as the sort has partitions.
    """
    told = scratch.keep(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = told.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # bounded: one row for each partition of the sort
    told = told.join(F.broadcast(starts), part == F.col("_part"))
    return told.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit(_INSIDE))).drop("_at", "_part", "_start")


def running(
    df: DataFrame, value: str, order: str, name: str, group: tuple[str, ...] = (), width: int = 4096
) -> DataFrame:
    """`df` with `name`, the sum of `value` over the rows of its group before it in `order` (whole numbers from 0).

    Rows are summed by ranges of `width` numbers; a task holds one range, or
    one row for each range.
    """
    told = df.withColumn("_cell", F.floor(F.col(order) / width))
    sums = told.groupBy(*group, "_cell").agg(F.sum(value).alias("_total"))
    outer = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_cell", F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*group, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("_before", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(sums, [*group, "_cell"])
    return told.withColumn(name, F.col("_start") + F.col("_before")).drop("_cell", "_before", "_start")
