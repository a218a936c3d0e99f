import json

import pytest
from pyspark.sql import functions as F

from skytrail.operators import episodes, geometry, metadata, stages


def test_patched():
    doc = {"episode_index": 3, "task_index": 1, "path": "data/chunk-000/episode_000003.parquet", "n": [{"episode_index": 3}], "length": 5}
    got = metadata.patched(doc, 3, 2500, 9)
    assert got == {"episode_index": 2500, "task_index": 9, "path": "data/chunk-002/episode_002500.parquet", "n": [{"episode_index": 2500}], "length": 5}
    assert metadata.with_counts({"total_episodes": 1, "a": {"n_frames": 2, "fps": 5}, "num_frames": "x"}, 7, 70) == {"total_episodes": 7, "a": {"n_frames": 70, "fps": 5}, "num_frames": "x"}


def test_documents_and_ids(spark):
    df = spark.createDataFrame([(json.dumps({"episode_index": 0}), 0, 4, None), (None, 1, 5, 1)], "doc string, old long, new long, task long")
    got = metadata.patch_documents(df, "doc", "old", "new", "task").collect()
    assert [r.doc and json.loads(r.doc) for r in got] == [{"episode_index": 4}, None]
    rows = spark.createDataFrame([(0, 7), (1, None)], "pos long, id long")
    assert [r.e for r in metadata.with_ids(rows, "episode", "pos", "e").orderBy("pos").collect()] == [7, 1]
    assert metadata.repack(rows, {"state": "id"}).columns == ["state"]
    p = spark.createDataFrame([(" ",), (None,), ("go",)], "p string")
    assert [r[0] for r in p.select(metadata.prompt_or(F.col("p"), "fly")).collect()] == ["fly", "fly", "go"]


def test_missing_metadata_is_made(spark):
    e = spark.createDataFrame([(0, 5, "a"), (1, 6, "b")], "ep long, length long, task string")
    m = spark.createDataFrame([(0, 50, ["x"])], "ep long, length long, tasks array<string>")
    s = spark.createDataFrame([(1, "{}")], "ep long, stats string")
    got = {r.ep: (r.length, r.tasks, r.stats) for r in metadata.with_metadata(e, m, s, ["ep"]).collect()}
    assert got == {0: (50, ["x"], None), 1: (6, ["b"], "{}")}


def test_validity_and_collect(spark):
    f = spark.createDataFrame([(1, 0.0, None), (1, 0.5, 0.0), (2, 0.0, 0.0)], "traj_id long, rgb_black double, depth_black double")
    assert [r[0] for r in metadata.valid_trajectories(metadata.frame_validity(f)).collect()] == [1, 2]
    assert [r[0] for r in metadata.valid_trajectories(metadata.frame_validity(f, 0.001)).collect()] == [2]
    s = spark.createDataFrame([(5, 1, "b", "p2", "e", 1), (5, 0, "a", "p1", "e", 0), (9, 0, "c", "p", "f", 2)], "episode long, step long, state string, prompt string, env_id string, pos long")
    got = metadata.collect_episodes(s, 1).collect()
    assert [(r.episode, r.states, r.prompt) for r in got] == [(5, ["a", "b"], "p1")]
    with pytest.raises(ValueError):
        metadata.collect_episodes(s.limit(0))


def test_overlay_and_vertex(spark):
    t = spark.createDataFrame([(1, "roof", 0), (2, "gone", 5), (3, "roof", 9)], "traj_id long, name string, pose_start long")
    o = spark.createDataFrame([("roof", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])], "name string, pts array<struct<x:double,y:double>>")
    p = spark.createDataFrame([(0,), (5,), (9,)], "pose_id long")
    i = spark.createDataFrame([(0, "0.png")], "pose_id long, path string")
    full, lost = metadata.overlay_inputs(t, o, p, i)
    assert [r.traj_id for r in full.collect()] == [1] and tuple(lost.first()) == (1, 1)
    at = spark.createDataFrame([("roof", 3.0, 1.0)], "name string, x double, y double")
    assert metadata.closest_vertex(o, at).first().vertex == 1


def test_errors_are_raised(spark):
    e = spark.createDataFrame([("e", 1, 0, 2, "go", 3)], "env_id string, traj_id long, pose_start long, pose_end long, instruction string, length long")
    poses = spark.createDataFrame([("e", 0, 1.0), ("e", 1, 1.0)], "env_id string, pose_id long, x double")
    with pytest.raises(Exception, match="pose_id=2 not found"):
        episodes.frames_of(e, poses, ["env_id"]).collect()
    assert episodes.frames_of(e, poses, ["env_id"], strict=False).count() == 2
    none = spark.createDataFrame([], "env_id string, traj_id long, subtask_id int, pose_start long, pose_end long, text string")
    assert stages.composed_text(e, none, ["traj_id"]).first().text == "go"
    with pytest.raises(Exception, match="no stage"):
        stages.composed_text(e, none, ["traj_id"], strict=True).collect()
    with pytest.raises(Exception, match="differ in length"):
        stages.positional(e.select("traj_id"), poses.select("pose_id"), ["traj_id"], ["pose_id"]).collect()
    with pytest.raises(ValueError, match="schema"):
        episodes.merge([e, e.drop("length")], ["traj_id"], ["instruction"])


def test_sequential_split():
    got = episodes.split_sequential([("a", list(range(10))), ("b", [1, 2])], {"b"})
    assert len(got["train"]) == 9 and len(got["test_seen"]) == 1 and sorted(got["test_unseen"]) == [1, 2]
    assert got == episodes.split_sequential([("a", list(range(10))), ("b", [1, 2])], {"b"})


def test_statistics_shift(spark):
    df = spark.createDataFrame([(1,)], "a long")
    s = metadata.F.struct(*[F.array(F.lit(v)).alias(k) for k, v in (("min", 0.0), ("max", 9.0), ("mean", 4.5), ("std", 2.0))], F.array(F.lit(10)).alias("count"))
    got = df.select(episodes.shift_stats(s, F.lit(100.0)).alias("s"), episodes.constant_stats(F.lit(7), F.lit(10)).alias("c")).first()
    assert (got.s.min, got.s.mean, got.s.std) == ([100.0], [104.5], [2.0]) and (got.c.min, got.c.std, got.c["count"]) == ([7.0], [0.0], [10])


def test_cut_corners_of_three_points(spark):
    p = spark.createDataFrame([([(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (4.0, 4.0, 0.0)],)], "p array<struct<x:double,y:double,z:double>>")
    got = p.select(geometry.cut_corners(F.col("p"), 1).alias("q")).first().q
    assert [(r.x, r.y) for r in got] == [(0, 0), (1, 0), (3, 0), (4, 1), (4, 3), (4, 4)]
