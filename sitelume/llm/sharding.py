"""Placement of documents on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def preference(shard: str, slots: int) -> tuple[int, int]:
    """First slot and step of a shard's preference order, a permutation as `slots` is prime."""
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def fill_table(shards: list[str], slots: int = 65_537) -> list[int]:
    """The shard (its index) of each slot: shards in turn claim the next free slot of their preference order.

    `slots` is a prime well above the number of shards. Turns differ by at most
    one slot a shard, and a shard that comes or goes moves few other slots.
    """
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not a prime")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, one at least, and no more than slots")
    order = [preference(s, slots) for s in shards]
    at, table, free = [0] * len(shards), [-1] * slots, slots
    while free:
        for k, (first, step) in enumerate(order):
            while True:
                slot = (first + at[k] * step) % slots
                at[k] += 1
                if table[slot] < 0:
                    break
            table[slot] = k
            free -= 1
            if not free:
                break
    return table


def lookup_frame(spark: SparkSession, shards: list[str], slots: int = 65_537) -> DataFrame:
    """The table as rows of slot and shard; `slots` rows, whatever the data."""
    return spark.createDataFrame(list(enumerate(shards[k] for k in fill_table(shards, slots))), "slot int, shard string")


def place(docs: DataFrame, shards: list[str], id_col: str = "doc_id", slots: int = 65_537) -> DataFrame:
    """`docs` with slot and shard (columns of those names are replaced).

    A row's slot is the hash of its id modulo `slots`; the table is broadcast,
    so each row is placed by one lookup and nothing is shuffled. Rows of one id
    share a shard, null ids one too. Empty table: no rows.
    """
    table = F.broadcast(lookup_frame(docs.sparkSession, shards, slots))  # bounded by `slots`
    docs = docs.drop("slot", "shard")
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return docs.withColumn("slot", (key % slots).cast("int")).join(table, "slot")
