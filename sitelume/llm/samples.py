"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 20


def share_of(*columns: str) -> Column:
    """A pseudorandom number from 0 to 1 that the values of `columns` fix."""
    return F.pmod(F.xxhash64(*columns), F.lit(_PARTS)) / float(_PARTS)


def with_labels(rows: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """`rows` (id, text) that `chosen` (id, label; at most about `most` ids) labels, about `most` at most.

    One id may be on very many rows: where the chosen ids have more rows than
    `most`, a hash of id and text decides which of them stay. Rows equal in
    both stay or go together; callers drop repeated ones before they collect.
    """
    chosen = F.broadcast(chosen)  # bounded: about `most` rows of two numbers
    n = rows.select("id").join(chosen, "id").count()
    labelled = rows.join(chosen, "id")
    return labelled if n <= most else labelled.where(share_of("id", "text") < most / n)
