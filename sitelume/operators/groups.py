"""Joins of rows with a table of their groups, safe where one group holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tasks that the rows of one group are dealt to.
SALTS = 8


def join_groups(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join of `rows` with `groups` (one row for each key), inner or left.

    The rows of a key are dealt to SALTS tasks by a hash of the row, and each
    group goes to all of them, so the largest group is no single task, and rows
    and groups are each worked out once. Rows without a key are dealt alike.
    """
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)))
    every = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(every, [key, "_salt"], how).drop("_salt")


def sample_of_each(rows: DataFrame, keys: list[str], order: list[str], n: int = 3) -> DataFrame:
    """The first `n` rows of each key; no more than that many of a task's rows of a key are shuffled."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
