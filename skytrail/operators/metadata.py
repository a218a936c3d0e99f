"""Metadata of merged datasets: renamed columns, fallbacks, rewritten documents, joined statistics."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The names under which documents hold ids, texts and counts.
ID_KEYS = {"episode": ["episode_index", "id", "index"], "task": ["task_index", "id", "index"]}
TEXT_KEYS = ["task", "text", "instruction", "name"]
EPISODE_COUNTS = ["total_episodes", "num_episodes", "episodes_count", "n_episodes"]
FRAME_COUNTS = ["total_frames", "num_frames", "frames_count", "n_frames"]


def repack(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under new names (new: old), in that order."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def first_present(df: DataFrame, names: list[str], default: Column | None = None) -> Column:
    """The first of the named columns that the table has and that isn't null in a row."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there, *([default] if default is not None else [])) if there or default is not None else F.lit(None)


def prompt_or(column: Column, default: str) -> Column:
    """Blank prompts become the default."""
    return F.when(F.trim(F.coalesce(column, F.lit(""))) == "", default).otherwise(column)


def with_ids(rows: DataFrame, kind: str, order: str, out: str) -> DataFrame:
    """Adds the id of each metadata row: the first id column that is there, else its place."""
    place = (F.row_number().over(Window.orderBy(order)) - 1).cast("long")
    return rows.withColumn(out, first_present(rows, ID_KEYS[kind], place).cast("long"))


def stem(i: int) -> str:
    return f"episode_{i:06d}"


def patched(doc: Any, old: int | None, new: int | None, task: int | None = None, chunk: int = 1000) -> Any:
    """A document with the indexes of an episode and its task, and the path tokens of its texts, rewritten."""

    def walk(x: Any, key: str | None = None) -> Any:
        if isinstance(x, dict):
            return {k: walk(v, k) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        if isinstance(x, int) and key == "episode_index" and new is not None:
            return new
        if isinstance(x, int) and key == "task_index" and task is not None:
            return task
        if isinstance(x, str) and new is not None:
            text = x.replace(stem(old), stem(new)) if old is not None else x
            return re.sub(r"chunk-\d{3,}", f"chunk-{new // chunk:03d}", text)
        return x

    return walk(doc)


def with_counts(doc: Any, episodes: int, frames: int) -> Any:
    """A document with its counts of episodes and frames replaced, whatever they are called."""
    if isinstance(doc, dict):
        counts = dict.fromkeys(EPISODE_COUNTS, episodes) | dict.fromkeys(FRAME_COUNTS, frames)
        return {k: counts[k] if k in counts and isinstance(v, int) else with_counts(v, episodes, frames) for k, v in doc.items()}
    return [with_counts(v, episodes, frames) for v in doc] if isinstance(doc, list) else doc


def patch_documents(rows: DataFrame, doc: str, old: str, new: str, task: str) -> DataFrame:
    """patched() over a column of JSON texts, in Arrow batches; null documents stay null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        number = lambda v: None if pd.isna(v) else int(v)
        for docs, olds, news, tasks in batches:
            yield pd.Series([None if d is None else json.dumps(patched(json.loads(d), number(o), number(n), number(t))) for d, o, n, t in zip(docs, olds, news, tasks, strict=True)], dtype=object)

    return rows.withColumn(doc, run(F.col(doc), F.col(old), F.col(new), F.col(task)))


def with_metadata(episodes: DataFrame, meta: DataFrame, stats: DataFrame, key: list[str]) -> DataFrame:
    """Episodes with their metadata and statistics; without a metadata row the length is that of the
    file and the tasks are its one task."""
    both = episodes.join(meta.select(*key, F.col("length").alias("_l"), F.col("tasks").alias("_t")), key, "left").join(stats.select(*key, "stats"), key, "left")
    return both.withColumns({"length": F.coalesce("_l", "length"), "tasks": F.coalesce("_t", F.array("task"))}).drop("_l", "_t")


def frame_validity(frames: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Adds valid: the shares of black pixels and of missing depth (null: none) are not above the
    threshold.  The default never rejects, as shares are at most 1."""
    ok = [F.coalesce(F.col(c), F.lit(0.0)) <= threshold for c in ("rgb_black", "depth_black")]
    return frames.withColumn("valid", ok[0] & ok[1])


def valid_trajectories(frames: DataFrame) -> DataFrame:
    """Ids of the trajectories all of whose frames are valid, in order."""
    return frames.groupBy("traj_id").agg(F.bool_and(F.coalesce("valid", F.lit(False))).alias("v")).filter("v").select("traj_id").orderBy("traj_id")


def collect_episodes(samples: DataFrame, limit: int = 0) -> DataFrame:
    """One row an episode: states by step, and the metadata of the row that comes first (`pos`); with a
    limit, the first so many episodes.  No samples are an error."""
    if samples.isEmpty():
        raise ValueError("the dataset has no samples")
    e = samples.groupBy("episode").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "state"))), lambda s: s["state"]).alias("states"), F.min_by("prompt", "pos").alias("prompt"), F.min_by("env_id", "pos").alias("env_id"), F.min("pos").alias("_pos"))
    e = e.orderBy("_pos")
    return (e.limit(limit) if limit else e).drop("_pos")


def overlay_inputs(trajectories: DataFrame, outlines: DataFrame, poses: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trajectories with outline, first pose and image; counts of those without outline, without image)."""
    first = F.col("pose_start") == F.col("pose_id")
    named = trajectories.join(outlines.select("name", "pts"), "name")
    posed = named.join(poses, first)
    full = posed.join(images.select("pose_id", "path"), "pose_id")
    lost = trajectories.join(outlines, "name", "left_anti").agg(F.count("*").alias("miss_outline"))
    return full, lost.crossJoin(posed.join(images, "pose_id", "left_anti").agg(F.count("*").alias("miss_image")))  # one row each


def closest_vertex(outlines: DataFrame, points: DataFrame) -> DataFrame:
    """The index of each outline's vertex that is nearest to its point; the first of equally near ones."""
    v = outlines.select("name", F.posexplode("pts").alias("i", "p")).join(points, "name")
    d2 = F.pow(F.col("p.x") - F.col("x"), 2) + F.pow(F.col("p.y") - F.col("y"), 2)
    return v.groupBy("name").agg(F.min_by("i", F.struct(d2, F.col("i"))).alias("vertex"))


def limited_shards(episodes: DataFrame, order: list[str], limit: int, shards: int) -> DataFrame:
    """The first `limit` episodes (0: all) in order, each with the shard that it is dealt to in turn."""
    place = (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")
    out = episodes.withColumn("_at", place)
    out = out.filter(F.col("_at") < limit) if limit > 0 else out
    return out.withColumn("shard", (F.col("_at") % shards).cast("int")).drop("_at")


def key_difference(wanted: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has: key, side (missing: only wanted; extra: only found)."""
    a, b = wanted.select(*key).distinct(), found.select(*key).distinct()
    missing, extra = a.join(b, key, "left_anti"), b.join(a, key, "left_anti")
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("extra")))


def signature(env: Column, instruction: Column, length: Column) -> Column:
    """What two descriptions of one episode must share: scene, text and length."""
    return F.struct(F.coalesce(env, F.lit("")).alias("env_id"), instruction.alias("instruction"), length.cast("long").alias("length"))


def checked_rows(tasks: DataFrame, whole: DataFrame) -> DataFrame:
    """Task rows (position, task_id, env_id, instruction, length) beside the rows of the whole (episode_index,
    and the same) that they should be, and what is wrong: "count", "index", "task", "signature" or null.

    Positions run from 0 without gaps; a row without a partner is of a wrong count.
    """
    w = Window.orderBy("episode_index")
    theirs = whole.select((F.row_number().over(w) - 1).cast("long").alias("position"), "episode_index", F.col("task_id").alias("_task"), signature(F.col("env_id"), F.col("instruction"), F.col("length")).alias("_theirs"))
    ours = tasks.select("position", "task_id", signature(F.col("env_id"), F.col("instruction"), F.col("length")).alias("_ours"))
    both = ours.join(theirs, "position", "full")
    wrong = F.when(F.col("_ours").isNull() | F.col("_theirs").isNull(), "count").when(F.col("episode_index") != F.col("position"), "index")
    wrong = wrong.when(~F.col("_task").eqNullSafe(F.col("task_id")), "task").when(~F.col("_ours").eqNullSafe(F.col("_theirs")), "signature")
    return both.select("position", "episode_index", "task_id", wrong.alias("wrong"))


def aligned(truth: DataFrame, pred: DataFrame, key: list[str]) -> DataFrame:
    """Both trajectories up to the end of the shorter one."""
    return truth.join(pred, [*key, "frame_index"])


def pipeline(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One transform of several, in order."""

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run
