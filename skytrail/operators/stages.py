"""Stages of episodes: interval joins, coverage, composed texts, and alignment to released episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytrail.functions import angles

KEYS = ["env_id", "traj_id"]


def overlaps(episodes: DataFrame, stages: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """A row for each stage that meets an episode, clipped to it, with frame_start and frame_end."""
    s = stages.select(*keys, "subtask_id", "text", F.col("pose_start").alias("_s"), F.col("pose_end").alias("_e"))
    both = episodes.join(s, keys).filter((F.col("_s") <= F.col("pose_end")) & (F.col("_e") >= F.col("pose_start")))
    lo, hi = F.greatest("_s", "pose_start"), F.least("_e", "pose_end")
    return both.withColumns({"stage_start": lo, "stage_end": hi, "frame_start": lo - F.col("pose_start"), "frame_end": hi - F.col("pose_start")}).drop("_s", "_e")


def cover_check(episodes: DataFrame, stages: DataFrame, id_cols: list[str], keys: list[str] = KEYS) -> DataFrame:
    """For each episode the number of frames in no stage, and in several."""
    marks = overlaps(episodes, stages, keys).select(*id_cols, F.explode(F.sequence("frame_start", "frame_end")).alias("frame"))
    per = marks.groupBy(*id_cols, "frame").count().groupBy(*id_cols).agg(F.count("*").alias("_any"), F.sum((F.col("count") > 1).cast("long")).alias("_many"))
    return episodes.join(per, id_cols, "left").select(*id_cols, (F.col("length") - F.coalesce("_any", F.lit(0))).cast("long").alias("uncovered"), F.coalesce("_many", F.lit(0)).cast("long").alias("multiply_covered"))


def composed_text(episodes: DataFrame, stages: DataFrame, id_cols: list[str], joiner: str = " ", strict: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Texts of an episode's stages by (subtask_id, start, end), trimmed; blanks and equal neighbours
    left out.  Without any: the episode's own instruction, or with strict an error."""
    s = stages.select(*keys, "subtask_id", F.trim("text").alias("text"), F.col("pose_start").alias("_s"), F.col("pose_end").alias("_e"))
    near = episodes.select(*id_cols, *[k for k in keys if k not in id_cols], F.col("pose_start").alias("_ps"), F.col("pose_end").alias("_pe")).join(s, keys).filter("_e >= _ps and _s <= _pe and text <> ''")
    items = near.groupBy(*id_cols).agg(F.array_sort(F.collect_list(F.struct("subtask_id", "_s", "_e", "text"))).alias("_items"))
    texts = F.transform("_items", lambda x: x["text"])
    kept = F.aggregate(texts, F.array().cast("array<string>"), lambda acc, t: F.when(F.coalesce(F.get(acc, F.size(acc) - 1) == t, F.lit(False)), acc).otherwise(F.array_append(acc, t)))
    missing = F.raise_error(F.lit("an episode has no stage")).cast("string") if strict else F.col("instruction")
    return episodes.join(items, id_cols, "left").select(*id_cols, F.when(F.col("_items").isNull(), missing).otherwise(F.array_join(kept, joiner)).alias("text"))


def extents(stages: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return stages.groupBy(*keys).agg(F.min("pose_start").alias("pose_start"), F.max("pose_end").alias("pose_end"))


def flight_start(frames: DataFrame, key: list[str], eps: float = 1e-6) -> DataFrame:
    """The first frame whose action moves; null if none does (the caller decides if that is an error)."""
    moved = F.greatest(F.abs("dx"), F.abs("dy"), F.abs("dz")) > eps
    return frames.groupBy(*key).agg(F.min(F.when(moved, F.col("frame_index"))).alias("fly_start"), F.count("*").alias("length"))


def turn_and_fly(frames: DataFrame, key: list[str]) -> DataFrame:
    """Recovered stages of an obstacle episode: turning until the first move, then flying."""
    f = flight_start(frames, key)
    f = f.withColumn("fly_start", F.when(F.col("fly_start").isNull(), F.raise_error(F.lit("no flight phase")).cast("long")).otherwise(F.col("fly_start")))
    turn = F.when(F.col("fly_start") > 0, F.struct(F.lit(0).alias("subtask_id"), F.lit(0).cast("long").alias("frame_start"), (F.col("fly_start") - 1).cast("long").alias("frame_end")))
    fly = F.struct(F.lit(1).alias("subtask_id"), F.col("fly_start").cast("long").alias("frame_start"), (F.col("length") - 1).cast("long").alias("frame_end"))
    return f.select(*key, F.explode(F.array_compact(F.array(turn, fly))).alias("_s")).select(*key, "_s.*")


def positional(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str]) -> DataFrame:
    """Rows of both tables side by side in their orders; different counts are an error."""
    a = left.withColumn("_p", F.row_number().over(Window.orderBy(*order_left))).withColumn("_a", F.lit(True))
    b = right.withColumn("_p", F.row_number().over(Window.orderBy(*order_right))).withColumn("_b", F.lit(True))
    both = a.join(b, "_p", "full")
    wrong = F.col("_a").isNull() | F.col("_b").isNull()
    return both.withColumn("position", F.when(wrong, F.raise_error(F.lit("the tables differ in length")).cast("long")).otherwise((F.col("_p") - 1).cast("long"))).drop("_p", "_a", "_b")


def match_endpoints(episodes: DataFrame, candidates: DataFrame, keys: list[str], states: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Each episode with the one candidate of equal keys whose states all lie within the tolerance.

    episodes: episode_index, keys, states; candidates: candidate, keys, states.  Adds n_matches, and
    taken, whether another episode matches the same candidate; candidate is null unless the match is
    the only one both ways.
    """
    c = candidates.select("candidate", *keys, *[F.col(s).alias(f"_{s}") for s in states])
    near = episodes.join(c, keys)
    for s in states:
        near = near.filter(F.abs(F.col(s) - F.col(f"_{s}")) <= tolerance)
    pairs = near.select("episode_index", "candidate")
    by_episode = pairs.groupBy("episode_index").agg(F.count("*").alias("n_matches"), F.min("candidate").alias("candidate"))
    users = pairs.groupBy("candidate").agg(F.count("*").alias("_users"))
    out = episodes.select("episode_index").join(by_episode, "episode_index", "left").join(users, "candidate", "left")
    only = (F.col("n_matches") == 1) & (F.col("_users") == 1)
    return out.select("episode_index", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce(F.col("_users") > 1, F.lit(False)).alias("taken"), F.when(only, F.col("candidate")).alias("candidate"))


def averaged_chunks(chunks: DataFrame, key: str = "episode") -> DataFrame:
    """Mean of all predicted actions for a step: chunks (episode, start_step, actions) overlap; the
    angle is averaged as a number and wrapped then."""
    flat = chunks.select(key, "start_step", F.posexplode("actions").alias("_i", "_a")).withColumn("step", F.col("start_step") + F.col("_i"))
    mean = flat.groupBy(key, "step").agg(F.count("*").alias("n"), *[F.avg(F.col("_a")[i].cast("double")).alias(c) for i, c in enumerate(("dx", "dy", "dz", "dyaw"))])
    return mean.withColumn("dyaw", angles.wrap_rad("dyaw"))
