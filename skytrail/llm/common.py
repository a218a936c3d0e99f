"""Shared pieces: written tables, Arrow batches of bounded size, ranks without a hot partition."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Upper bound of what may be broadcast: rows of two or three longs, or as many longs in arrays.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where it is unset and the master is local,
    as in tests, one of our own; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="skytrail-"))
    return path.rstrip("/")


_OWN: dict[str, str] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Texts can be very long, so Arrow batches are bounded by rows and bytes.

    Spark reads these settings when a query runs, after its operators have returned; so they are set
    for the session and stay.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skytrail/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, only where the counted rows are within the limit; else the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed_rank(df: DataFrame, keys: list[str], order: Column, ties: list[str], out: str, rows: int, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Adds `out`, the 0-based rank of each row within keys by (order, ties), with no task per key.

    order is a long that is spread evenly (a hash).  Its top bits split each key into buckets; ranks
    within a bucket come from a window, offsets of buckets from their counts.  keys must not be null.
    df must be cheap to read twice (a stash).
    """
    bits = max(6, (max(1, rows) // rows_per_bucket).bit_length())
    ranked = df.withColumn("_o", order).withColumn("_b", F.shiftright("_o", 64 - bits))
    w = Window.partitionBy(*keys, "_b").orderBy("_o", *ties)
    offsets = ranked.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    offsets = offsets.withColumn("_start", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).drop("_n")
    ranked = ranked.withColumn("_r", F.row_number().over(w) - 1)
    return ranked.join(offsets, [*keys, "_b"]).withColumn(out, (F.col("_r") + F.col("_start")).cast("long")).drop("_o", "_b", "_r", "_start")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every node of edges (a, b): comp is the smallest id reachable.

    Alternating large-star and small-star steps on written tables, O(log n) rounds in practice; no
    link leaves the executors.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")).toDF("u", "v") if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(low, "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        return out.filter("a <> b").distinct()

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = stash(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    before = None
    while (now := digest(edges)) != before and now[0]:
        before = now
        edges = stash(star(star(edges, True), False), "star")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).groupBy("id").agg(F.min("comp").alias("comp"))
