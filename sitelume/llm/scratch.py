"""Intermediate tables that cut lineage and survive lost executors.

A table is written as Parquet below the shared folder that the session names
in ``spark.checkpoint.dir`` and read again, so a later failure recomputes from
files and not from the start. Where the session names none, a local folder is
used on one machine (tests), and anything else is an error. Tables go when the driver ends, or earlier by
`drop`.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder of this session."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = checkpoint.get() if checkpoint.isDefined() else None
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="sitelume-"))
        place = _own[0]
    return place.rstrip("/")


class Scratch:
    """Tables of one operator call."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{folder(spark)}/sitelume-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._count = 0
        atexit.register(self.close)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write `df` and return it as read from the files."""
        path = f"{self.root}/{self._count}"
        self._count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for df in frames:
            path = self._paths.pop(id(df), None)
            if path:
                self._delete(path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended before the driver does
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """`df` reduced to the named columns, so that clashing extra ones are gone."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def as_long(name: str):
    return F.col(name).cast("long")
