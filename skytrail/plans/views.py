"""Trajectory views over the driver's tables, in Spark and, for the oracle, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPISODE = 50  # vectors an episode


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth (x, y, z, a) and prediction (px, py, pz, pa) of episodes of 50 frames."""
    names = ["x", "y", "z", "a", "px", "py", "pz", "pa"]
    e = table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {EPISODE}").alias("episode_index"), F.expr(f"vec_id % {EPISODE}").alias("frame_index"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    env = F.expr("episode_index % 4")
    return e.withColumns({"env_id": F.concat(F.lit("env_"), env.cast("string")), "split": F.when(env == 3, "unseen").otherwise("seen"), "task": F.concat(F.lit("task_"), F.expr("episode_index % 3").cast("string"))})


FRAMES = f"""v_frames as (
  select vec_id // {EPISODE} episode_index, vec_id % {EPISODE} frame_index,
         embedding[1]::double x, embedding[2]::double y, embedding[3]::double z, embedding[4]::double a,
         embedding[5]::double px, embedding[6]::double py, embedding[7]::double pz, embedding[8]::double pa,
         'env_' || ((vec_id // {EPISODE}) % 4)::varchar env_id,
         case when (vec_id // {EPISODE}) % 4 = 3 then 'unseen' else 'seen' end split,
         'task_' || ((vec_id // {EPISODE}) % 3)::varchar task
  from embeddings)"""


def v_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track a user: positions by (ts, event_id), a state made of each event's value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.col("value").cast("double").alias("value"))
    e = e.withColumn("pose_id", (F.row_number().over(w) - 1).cast("long"))
    return e.select(F.col("user_id").alias("traj_id"), "pose_id", F.concat(F.lit("env_"), F.expr("user_id % 5").cast("string")).alias("env_id"), "event_type", F.col("value").alias("x"), (F.col("value") * 0.5).alias("y"), (F.col("pose_id") * 0.25).alias("z"), (F.col("value") * 7.0).alias("kappa"), (F.col("value") * 3.0).alias("phi"))


TRACK = """v_track as (
  select traj_id, pose_id, 'env_' || (traj_id % 5)::varchar env_id, event_type, v x, v * 0.5e0 y,
         pose_id * 0.25e0 z, v * 7e0 kappa, v * 3e0 phi
  from (select user_id traj_id, event_type, value::double v,
               row_number() over (partition by user_id order by ts, event_id) - 1 pose_id from events))"""

STAGE = 7  # poses a stage


def v_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes: tracks cut into ranges of 20 poses, a short last one included."""
    t = v_track(spark, sf_dir)
    e = t.groupBy("traj_id", "env_id", F.expr("pose_id div 20").alias("part")).agg(F.min("pose_id").alias("pose_start"), F.max("pose_id").alias("pose_end"), F.min_by("event_type", "pose_id").alias("instruction"))
    return e.withColumn("length", F.expr("pose_end - pose_start + 1"))


EPISODES = """v_episode as (
  select traj_id, env_id, pose_id // 20 part, min(pose_id) pose_start, max(pose_id) pose_end,
         arg_min(event_type, pose_id) instruction, max(pose_id) - min(pose_id) + 1 length
  from v_track group by 1, 2, 3)"""


def v_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages: runs of 7 poses of a track; every fifth track lacks its stage 1, and each trackʼs
    stage 2 of tracks divisible by 7 starts a pose early."""
    t = v_track(spark, sf_dir)
    s = t.groupBy("traj_id", "env_id", F.expr(f"pose_id div {STAGE}").alias("subtask_id")).agg(F.min("pose_id").alias("pose_start"), F.max("pose_id").alias("pose_end"), F.min_by("event_type", "pose_id").alias("text"))
    s = s.filter("not (traj_id % 5 = 0 and subtask_id = 1)")
    return s.withColumn("pose_start", F.expr("case when traj_id % 7 = 0 and subtask_id = 2 then pose_start - 1 else pose_start end"))


STAGES = f"""v_stage as (
  select traj_id, env_id, subtask_id, case when traj_id % 7 = 0 and subtask_id = 2 then pose_start - 1 else pose_start end pose_start, pose_end, text
  from (select traj_id, env_id, pose_id // {STAGE} subtask_id, min(pose_id) pose_start, max(pose_id) pose_end, arg_min(event_type, pose_id) text
        from v_track group by 1, 2, 3)
  where not (traj_id % 5 = 0 and subtask_id = 1))"""


def with_views(*views: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",\n".join(views) + "\n"
