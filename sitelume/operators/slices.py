"""Windows and folds over the rows of a key in time order, in time slices, so that the rows of one key are many tasks.

A window of a key is worked out in two levels: within a slice of `SLICE_MS`, and
over one row for each slice of the key. Null keys are one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of a slice.
SLICE_MS = 24 * 3_600_000
_NEVER = -(1 << 62)


def sliced(rows: DataFrame, keys: list[str | Column], ms: Column) -> DataFrame:
    """`rows` with _key (a struct, so that nulls are equal) and _slice; rows without a time are a slice before all others."""
    return rows.withColumns({"_key": F.struct(*keys), "_slice": F.coalesce(F.floor(ms / SLICE_MS), F.lit(_NEVER))})


def running_sum(rows: DataFrame, value: Column, order: list[str], name: str) -> DataFrame:
    """`name`: the sum of `value` over the rows of the key up to this one; `rows` are sliced."""
    place = ["_key", "_slice"]
    inner = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*place).agg(F.sum(value).alias("_sum"))
    starts = sums.select(*place, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_start"))
    told = rows.withColumn(name, F.sum(value).over(inner)).join(starts, place)
    return told.withColumn(name, F.col(name) + F.col("_start")).drop("_start")


def last_before(rows: DataFrame, value: Column, order: list[str], name: str) -> DataFrame:
    """`name`: the last `value` that is not null of the key's rows before this one; values never fall in the order of the rows."""
    place = ["_key", "_slice"]
    inner = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*place).agg(F.max(value).alias("_top"))
    starts = tops.select(*place, F.max("_top").over(outer).alias("_start"))
    told = rows.withColumn(name, F.max(value).over(inner)).join(starts, place)
    return told.withColumn(name, F.coalesce(name, "_start")).drop("_start")


def fold(
    rows: DataFrame, keys: list[str], order: list[str], new: Callable[[], object], step: Callable[[object, tuple], tuple], added: dict[str, tuple[str, pa.DataType]]
) -> DataFrame:
    """`rows` with the columns of `added` (name to its SQL and Arrow type), which `step` makes of the state of a row's keys and the row.

    A task reads its keys sorted, in Arrow batches, and holds the state of one
    at a time, however many rows that has. Nulls of a key are equal.
    """
    names = rows.columns
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(row[k] if row[k] == row[k] else "NaN" for k in at)
                if key != now:
                    now, state = key, new()
                out.append(step(state, row))
            fresh = [pa.array([o[n] for o in out], kind) for n, (_, kind) in enumerate(added.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *fresh], [*names, *added])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{n} {sql}" for n, (sql, _) in added.items()]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ", ".join(kinds))
