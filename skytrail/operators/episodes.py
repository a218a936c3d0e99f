"""Building episodes: poses to frames and actions, dictionaries, renumbering, splits, statistics."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrail.functions import angles


def frames_of(episodes: DataFrame, poses: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """A row for each pose id in [pose_start, pose_end] of an episode, with its pose.

    The range join is an explode and an equi-join.  strict: a missing pose is an error; else it is
    left out, and so are episodes without any.
    """
    ids = episodes.withColumn("pose_id", F.explode(F.sequence("pose_start", "pose_end"))).withColumn("frame_index", F.col("pose_id") - F.col("pose_start"))
    if not strict:
        return ids.join(poses, [*keys, "pose_id"])
    found = ids.join(poses.withColumn("_found", F.lit(True)), [*keys, "pose_id"], "left")
    check = F.when(F.col("_found").isNull(), F.raise_error(F.format_string("pose_id=%d not found", "pose_id")).cast("long")).otherwise(F.col("pose_id"))
    return found.withColumn("pose_id", check).drop("_found")


def trajectories_or_poses(trajectories: DataFrame, poses: DataFrame) -> DataFrame:
    """Trajectories, or if there are none at all, one of a single pose for each pose."""
    single = poses.select(F.col("pose_id").alias("traj_id"), F.col("pose_id").alias("pose_start"), F.col("pose_id").alias("pose_end"))
    none = trajectories.limit(1).agg(F.count("*").alias("_n")).filter("_n = 0").drop("_n")
    return trajectories.select("traj_id", "pose_start", "pose_end").union(single.crossJoin(F.broadcast(none)))  # none: one row or no row


def actions(frames: DataFrame, key: list[str]) -> DataFrame:
    """Adds dx, dy, dz, dyaw to the next frame, zeros at the last; float32 states as recorded."""
    w = Window.partitionBy(*key).orderBy("frame_index")
    out = frames
    for c in "xyz":
        out = out.withColumn(f"d{c}", F.coalesce(F.lead(c).over(w) - F.col(c), F.lit(0.0)))
    turn = F.lead("a").over(w) - F.col("a")
    return out.withColumn("dyaw", F.when(turn.isNull(), 0.0).otherwise(angles.wrap_rad(turn)))


def roll_forward(frames: DataFrame, key: list[str]) -> DataFrame:
    """States from each episode's first state and its actions: running sums, the angle wrapped."""
    w = Window.partitionBy(*key).orderBy("frame_index")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    first = lambda c: F.first(c).over(w)
    out = {f"r{c}": first(c) + F.coalesce(F.sum(f"d{c}").over(before), F.lit(0.0)) for c in "xyz"}
    out["ra"] = angles.wrap_rad(first("a") + F.coalesce(F.sum("dyaw").over(before), F.lit(0.0)))
    return frames.withColumns(out)


def first_appearance(rows: DataFrame, keys: list[str], order: list[str], out: str = "task_index") -> DataFrame:
    """Dense ids of the distinct keys in the order in which they first occur.

    The window without a partition runs over the distinct keys alone (a task dictionary).
    """
    pos = F.min(F.struct(*order)).alias("_pos")
    return rows.groupBy(*keys).agg(pos).withColumn(out, (F.row_number().over(Window.orderBy("_pos", *keys)) - 1).cast("long")).drop("_pos")


def renumber(episodes: DataFrame, order: list[str], length: str = "length") -> DataFrame:
    """Adds episode_index, global and gapless, and frame_offset, the frames before the episode."""
    w = Window.orderBy(*order)
    offset = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return episodes.withColumn("episode_index", (F.row_number().over(w) - 1).cast("long")).withColumn("frame_offset", offset.cast("long"))


def merge(sources: list[DataFrame], order: list[str], task_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Union of sources with schemas that must agree: (episodes renumbered with task_index, tasks)."""
    first = sources[0].schema
    for i, s in enumerate(sources):
        if [(f.name, f.dataType) for f in s.schema] != [(f.name, f.dataType) for f in first]:
            raise ValueError(f"the schema of source {i} differs")
    parts = [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    tasks = first_appearance(rows, task_keys, ["source", *order])
    return renumber(rows.join(tasks, task_keys), ["source", *order]), tasks


def shard_order(episodes: DataFrame, shards: int, order: str) -> DataFrame:
    """Adds the position that an episode has after dealing episodes round-robin to shards and
    joining the shards one after another."""
    i = (F.row_number().over(Window.orderBy(order)) - 1).cast("long")
    df = episodes.withColumn("_i", i)
    return df.withColumn("position", (F.row_number().over(Window.orderBy(F.col("_i") % shards, "_i")) - 1).cast("long")).drop("_i")


def split(episodes: DataFrame, unseen: list[str], ratio: float = 0.9, seed: int = 42, key: list[str] = ("traj_id", "pose_start")) -> DataFrame:
    """Adds split: test_unseen for unseen scenes; in others round(n * ratio) episodes (halves to even)
    in an order by a seeded digest are train, the rest test_seen."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "env_id", *key))
    w = Window.partitionBy("env_id")
    df = episodes.withColumn("_r", F.row_number().over(w.orderBy(digest, *key))).withColumn("_n", F.count("*").over(w))
    cut = F.bround(F.col("_n") * F.lit(float(ratio)), 0)
    return df.withColumn("split", F.when(F.col("env_id").isin(list(unseen)), "test_unseen").when(F.col("_r") <= cut, "train").otherwise("test_seen")).drop("_r", "_n")


def split_sequential(envs: list[tuple[str, list]], unseen: set[str], ratio: float = 0.9, seed: int = 42) -> dict[str, list]:
    """The split that one sequential generator makes, scene after scene (small lists on the driver)."""
    rng, out = random.Random(seed), {"train": [], "test_seen": [], "test_unseen": []}
    for env, episodes in envs:
        shuffled = list(episodes)
        rng.shuffle(shuffled)
        cut = round(len(shuffled) * ratio)
        if env in unseen:
            out["test_unseen"] += shuffled
        else:
            out["train"] += shuffled[:cut]
            out["test_seen"] += shuffled[cut:]
    return out


def set_constant(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Replaces a column, its type kept; a column that isn't there stays away."""
    return df.withColumn(column, value.cast(df.schema[column].dataType)) if column in df.columns else df


def horizon(frames: DataFrame, key: list[str], cols: list[str], steps: int) -> DataFrame:
    """Adds, for each column, the array of its values in the next `steps` frames, this one included;
    shorter at the end of an episode."""
    w = Window.partitionBy(*key).orderBy("frame_index").rowsBetween(0, steps - 1)
    return frames.withColumns({f"{c}_chunk": F.collect_list(c).over(w) for c in cols})


def is_monotone(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Whether the value never falls in the rows' order, for each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    ok = F.coalesce(F.col(value) >= F.lag(value).over(w), F.lit(True)).alias("_ok")
    return rows.select(*key, ok).groupBy(*key).agg(F.bool_and("_ok").alias("monotone"))


def episode_stats(frames: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """A row for each episode and feature: min, max, mean, std (of the population), count."""
    long = frames.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_s"))
    v = F.col("_s.v")
    return long.groupBy(*key, F.col("_s.feature").alias("feature")).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("count"))


def constant_stats(value: Column, count: Column) -> Column:
    """Statistics of a feature that has one value in all frames (task and episode indexes)."""
    one = F.array(value.cast("double"))
    return F.struct(one.alias("min"), one.alias("max"), one.alias("mean"), F.array(F.lit(0.0)).alias("std"), F.array(count.cast("long")).alias("count"))


def shift_stats(stats: Column, by: Column) -> Column:
    """Statistics of a feature whose values all moved by the same amount."""
    move = lambda name: F.transform(stats[name], lambda v: v + by).alias(name)
    return F.struct(move("min"), move("max"), move("mean"), stats["std"].alias("std"), stats["count"].alias("count"))


def normalized(frames: DataFrame, cols: list[str], quantile: bool = False) -> DataFrame:
    """Columns scaled by mean and deviation, or from the 1st and 99th percentile to [-1, 1]."""
    if quantile:
        aggs = [F.percentile(c, [0.01, 0.99]).alias(f"_{c}") for c in cols]
        scale = {c: (F.col(c) - F.col(f"_{c}")[0]) / (F.col(f"_{c}")[1] - F.col(f"_{c}")[0] + 1e-6) * 2.0 - 1.0 for c in cols}
    else:
        aggs = [F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_{c}") for c in cols]
        scale = {c: (F.col(c) - F.col(f"_{c}.m")) / (F.col(f"_{c}.s") + 1e-6) for c in cols}
    both = frames.crossJoin(F.broadcast(frames.agg(*aggs)))  # one row of statistics
    return both.withColumns(scale).drop(*[f"_{c}" for c in cols])
