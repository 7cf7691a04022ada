"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build_session(app: str = "sitelume", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the queries assume; a cluster's own settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
    } | {k: str(v) for k, v in conf.items()}
    spark = builder.config(map=settings).getOrCreate()
    return share(spark)


def share(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it; of a key that JSON repeats the last one counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session's machines share.

    Only a session on this machine alone may do without `spark.checkpoint.dir`
    and gets a local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = "file://" + tempfile.mkdtemp(prefix="sitelume-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
