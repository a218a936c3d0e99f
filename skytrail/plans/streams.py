"""Queries over streams and whole datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.plans.catalog import query
from skytrail.plans.episodes import CHUNKS, chunks
from skytrail.plans.evaluation import sql_wrap
from skytrail.plans.views import table, with_views
from skytrail.sources.scratch import scratch_dir
from skytrail.streaming.chunks import average_stream, windowed_counts


@query("stream_chunk_average", with_views(CHUNKS) + f"select episode, step, count(*) n, round(avg(dx), 6) dx, round({sql_wrap('avg(dyaw)')}, 6) dyaw from flat group by 1, 2")
def stream_chunk_average(spark: SparkSession, d: str) -> DataFrame:
    """The chunk average from a stream of files, which is the same as from a batch."""
    root = scratch_dir(spark, "stream")
    c = chunks(spark, d).select("episode", F.col("start_step").cast("long").alias("start_step"), F.expr("transform(actions, a -> transform(a, v -> double(v)))").alias("actions"))
    ends = c.groupBy("episode").agg((F.max("start_step") + 1000).alias("start_step")).withColumn("actions", F.array().cast("array<array<double>>"))
    # Files come by rising steps, and an episode's chunks of one range lie in one file; each file is a batch.
    for lo, hi in ((0, 20), (20, 40), (40, 1 << 40)):
        part = c.filter(F.col("start_step").between(lo, hi - 1))
        part = part.unionByName(ends) if hi > 1000 else part
        part.repartition(2, "episode").write.mode("append").parquet(f"{root}/in")
    stream = average_stream(spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.select("episode", "step", "n", F.round("dx", 6).alias("dx"), F.round("dyaw", 6).alias("dyaw"))


@query("event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) n, round(sum(value::double), 4) total from events group by 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("value", F.col("value").cast("double"))
    return windowed_counts(e, "1 hour").withColumn("total", F.round("total", 4))


@query("content_manifest", "select doc_id, strlen(text) size_bytes, sha256(text) sha256 from documents")
def content_manifest(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", F.length(b).cast("long").alias("size_bytes"), F.sha2(b, 256).alias("sha256"))


@query("category_config", "select c_custkey, coalesce(r.radius, 20e0) radius from customer left join (values ('AUTOMOBILE', 40e0), ('BUILDING', 60e0)) r(seg, radius) on c_mktsegment = seg")
def category_config(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("AUTOMOBILE", 40.0), ("BUILDING", 60.0)], "c_mktsegment string, radius double")
    c = table(spark, d, "customer").join(F.broadcast(rules), "c_mktsegment", "left")  # two rules
    return c.select("c_custkey", F.coalesce("radius", F.lit(20.0)).alias("radius"))
