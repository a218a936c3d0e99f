"""The folder that driver and executors share, and tables written to it to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000  # rows of a few numbers that may be broadcast
_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession, tag: str = "work") -> str:
    """A new path below spark.checkpoint.dir.  Where that is unset and the master is local, as in tests,
    below a folder of our own; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="skytrail-"))
    return f"{root.rstrip('/')}/skytrail/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """df as a Parquet table, read back: it is computed once, and lost executors cost nothing."""
    path = scratch_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint, only where the counted rows are within the limit; else the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
