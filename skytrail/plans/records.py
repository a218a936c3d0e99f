"""Queries over metadata records, camera frames, texts and table functions."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.functions import camera, templates, text
from skytrail.operators import episodes, evaluate, generators, metadata, stages, tables
from skytrail.plans.catalog import query
from skytrail.plans.episodes import EPISODE
from skytrail.plans.evaluation import rounded
from skytrail.plans.geometry import landmarks, outlines
from skytrail.plans.views import EPISODES, FRAMES, STAGES, TRACK, table, v_episode, v_frames, v_stage, v_track, with_views


@query("repacked", "select o_orderkey key, case when trim(o_clerk) = '' then 'fly' else case when o_orderkey % 2 = 0 then 'fly' else o_clerk end end prompt, o_custkey id, 7::bigint pinned from (select *, o_orderpriority o_clerk from orders)")
def repacked(spark: SparkSession, d: str) -> DataFrame:
    """Columns under other names, the first of several names that is there, blank prompts, and a constant."""
    o = table(spark, d, "orders").withColumns({"raw": F.when(F.expr("o_orderkey % 2 = 0"), "  ").otherwise(F.col("o_orderpriority")), "o_pin": F.lit(1).cast("long")})
    r = metadata.repack(o, {"key": "o_orderkey", "raw": "raw", "o_custkey": "o_custkey", "pinned": "o_pin"})
    r = r.select("key", metadata.prompt_or(F.col("raw"), "fly").alias("prompt"), metadata.first_present(r, ["user", "o_custkey", "key"], F.lit(0)).alias("id"), "pinned")
    return episodes.set_constant(episodes.set_constant(r, "pinned", F.lit(7)), "absent", F.lit(1))


@query("first_ids", "select n_nationkey, case when n_nationkey % 3 = 0 then n_nationkey - 5 else coalesce(case when n_nationkey % 3 = 1 then n_regionkey end, n_nationkey) end id from nation")
def first_ids(spark: SparkSession, d: str) -> DataFrame:
    """The first id column with a value, else the row's place."""
    n = table(spark, d, "nation").select("n_nationkey", F.expr("case when n_nationkey % 3 = 0 then n_nationkey - 5 end").alias("episode_index"), F.expr("case when n_nationkey % 3 = 1 then n_regionkey end").alias("id"))
    return metadata.with_ids(n, "episode", "n_nationkey", "place").select("n_nationkey", F.col("place").alias("id"))


@query("patched_documents", """select s_suppkey, s_suppkey * 700 ep, 3::bigint task, 'data/chunk-' || lpad((s_suppkey * 700 // 1000)::varchar, 3, '0') || '/episode_' || lpad((s_suppkey * 700)::varchar, 6, '0') || '.parquet' path,
  5::bigint kept, s_suppkey * 700 inner_ep from supplier""")
def patched_documents(spark: SparkSession, d: str) -> DataFrame:
    doc = json.dumps({"episode_index": 1, "task_index": 0, "path": "data/chunk-000/episode_000001.parquet", "length": 5, "list": [{"episode_index": 1}]})
    s = table(spark, d, "supplier").select("s_suppkey", F.lit(doc).alias("doc"), F.lit(1).cast("long").alias("old"), (F.col("s_suppkey") * 700).alias("new"), F.lit(3).cast("long").alias("task"))
    out = metadata.patch_documents(s, "doc", "old", "new", "task")
    get = lambda path: F.get_json_object("doc", path)
    return out.select("s_suppkey", get("$.episode_index").cast("long").alias("ep"), get("$.task_index").cast("long").alias("task"), get("$.path").alias("path"), get("$.length").cast("long").alias("kept"), get("$.list[0].episode_index").cast("long").alias("inner_ep"))


@query("patched_counts", with_views(TRACK, EPISODES) + "select count(*) total_episodes, sum(length)::bigint n_frames, 5::bigint fps, 'x' num_frames from v_episode")
def patched_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a dataset's document, by whatever name it has them, from the episodes."""
    e = v_episode(spark, d).agg(F.count("*"), F.sum("length")).first()
    doc = metadata.with_counts({"total_episodes": 1, "a": {"n_frames": 2, "fps": 5}, "num_frames": "x"}, e[0], e[1])
    return spark.createDataFrame([(doc["total_episodes"], doc["a"]["n_frames"], doc["a"]["fps"], doc["num_frames"])], "total_episodes long, n_frames long, fps long, num_frames string")


@query("shifted_statistics", with_views(FRAMES) + """select episode_index, round(min(frame_index) + 100e0 * episode_index, 5) lo, round(max(frame_index) + 100e0 * episode_index, 5) hi, round(avg(frame_index) + 100 * episode_index, 5) mean,
  round(stddev_pop(frame_index), 5) std, count(*) n, 7e0 task_mean, 0e0 task_std from v_frames group by 1""")
def shifted_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of a feature that moved by an offset, and of one that is constant."""
    one = lambda c: F.array(c.cast("double"))
    f = F.col("frame_index")
    s = F.struct(one(F.min(f)).alias("min"), one(F.max(f)).alias("max"), one(F.avg(f)).alias("mean"), one(F.stddev_pop(f)).alias("std"), F.array(F.count(f)).alias("count"))
    e = v_frames(spark, d).groupBy("episode_index").agg(s.alias("s"))
    e = e.select("episode_index", episodes.shift_stats(F.col("s"), F.col("episode_index") * 100.0).alias("s"), episodes.constant_stats(F.lit(7), F.col("s.count")[0]).alias("t"))
    out = {"lo": F.col("s.min")[0], "hi": F.col("s.max")[0], "mean": F.col("s.mean")[0], "std": F.col("s.std")[0], "n": F.col("t.count")[0], "task_mean": F.col("t.mean")[0], "task_std": F.col("t.std")[0]}
    return rounded(e.select("episode_index", *[v.alias(k) for k, v in out.items()]), 5)


@query("limited_shards", with_views(TRACK, EPISODES) + "select traj_id, pose_start, (i % 16)::int shard from (select *, row_number() over (order by traj_id, pose_start) - 1 i from v_episode) where i < 100")
def limited_shards(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred episodes (the feature of this operator), dealt to shards."""
    return metadata.limited_shards(v_episode(spark, d), EPISODE, 100, 16).select(*EPISODE, "shard")


@query("key_difference", with_views(TRACK, EPISODES, STAGES) + """, a as (select distinct traj_id, pose_start from v_episode), b as (select distinct traj_id, pose_start from v_stage)
select *, 'missing' side from (select * from a except select * from b) union all select *, 'extra' from (select * from b except select * from a)""")
def key_difference(spark: SparkSession, d: str) -> DataFrame:
    return metadata.key_difference(v_episode(spark, d), v_stage(spark, d), EPISODE)


@query("checked_rows", with_views(TRACK, EPISODES) + """, r as (select *, row_number() over (order by traj_id, pose_start) - 1 i from v_episode)
select i as position, i episode_index, 't' || (i % 3) task_id, case when i % 11 = 6 then 'task' when i % 11 = 7 then 'signature' end wrong from r""")
def checked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that should be equal by position, some with another task or another text."""
    from pyspark.sql import Window

    i = (F.row_number().over(Window.orderBy(*EPISODE)) - 1).cast("long")
    e = v_episode(spark, d).withColumn("position", i).withColumn("task_id", F.concat(F.lit("t"), F.expr("position % 3").cast("string")))
    whole = e.select(F.col("position").alias("episode_index"), F.expr("case when position % 11 = 6 then 'other' else task_id end").alias("task_id"), "env_id", F.expr("case when position % 11 = 7 then 'other' else instruction end").alias("instruction"), "length")
    return metadata.checked_rows(e, whole)


@query("episodes_with_metadata", with_views(TRACK, EPISODES) + """select traj_id, pose_start, case when traj_id % 2 = 0 then length + 1 else length end length, case when traj_id % 2 = 0 then 'listed' else instruction end task,
  case when traj_id % 3 = 0 then 's' || traj_id end stats from v_episode""")
def episodes_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Episodes with their metadata and statistics, which are made up where they are missing."""
    e = v_episode(spark, d).withColumnRenamed("instruction", "task")
    meta = e.filter(F.expr("traj_id % 2 = 0")).select(*EPISODE, (F.col("length") + 1).alias("length"), F.array(F.lit("listed")).alias("tasks"))
    stats = e.filter(F.expr("traj_id % 3 = 0")).select(*EPISODE, F.concat(F.lit("s"), F.col("traj_id").cast("string")).alias("stats"))
    out = metadata.with_metadata(e, meta, stats, EPISODE)
    return out.select(*EPISODE, "length", F.col("tasks")[0].alias("task"), "stats")


@query("overlay_inputs", with_views(TRACK, EPISODES) + """, t as (select *, 'n' || (traj_id % 4) as name from v_episode), o as (select 'n' || i as name from range(3) r(i)), p as (select traj_id, pose_id from v_track where pose_id % 40 = 0)
select count(*) filter (pose_start % 40 = 0 and traj_id % 4 < 3) full_rows, count(*) filter (traj_id % 4 = 3) miss_outline from t""")
def overlay_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories with an outline, their first pose and its image; and how many lack an outline."""
    w = v_episode(spark, d).withColumn("name", F.concat(F.lit("n"), F.expr("traj_id % 4").cast("string"))).withColumn("pose_start", F.expr("traj_id * 100000 + pose_start"))
    o = spark.createDataFrame([(f"n{i}", [(0.0, 0.0)]) for i in range(3)], "name string, pts array<struct<x:double,y:double>>")
    p = v_track(spark, d).select(F.expr("traj_id * 100000 + pose_id").alias("pose_id"), F.expr("pose_id % 40").alias("m"))
    full, lost = metadata.overlay_inputs(w, o, p.select("pose_id"), p.filter("m = 0").select("pose_id", F.lit("a.png").alias("path")))
    return full.agg(F.count("*").alias("full_rows")).crossJoin(lost.select("miss_outline"))  # one row each


@query("closest_vertex", f"""with p as (select n_name as name, i, n_nationkey * 30e0 + (20 + 5 * (i % 3)) * cos(i * {2 * math.pi / 8!r}e0) x, n_regionkey * 40e0 + (15 + 4 * (i % 2)) * sin(i * {2 * math.pi / 8!r}e0) y, n_nationkey * 30e0 + 11 px, n_regionkey * 40e0 + 3 py from nation, range(8) r(i))
select name, arg_min(i, (x - px) ** 2 + (y - py) ** 2)::int vertex from p group by 1""")
def closest_vertex(spark: SparkSession, d: str) -> DataFrame:
    at = landmarks(spark, d).select("name", (F.col("x") + 11).alias("x"), (F.col("y") + 3).alias("y"))
    return metadata.closest_vertex(outlines(spark, d), at)


@query("collected_episodes", with_views(FRAMES) + "select episode_index episode, count(*) n, round(arg_min(x, frame_index), 6) first_state, round(arg_max(x, frame_index), 6) last_state, 'p' || (min(frame_index)) prompt, min(env_id) env_id from v_frames group by 1")
def collected_episodes(spark: SparkSession, d: str) -> DataFrame:
    f = v_frames(spark, d).select(F.col("episode_index").alias("episode"), F.col("frame_index").alias("step"), F.col("x").alias("state"), F.concat(F.lit("p"), F.col("frame_index").cast("string")).alias("prompt"), "env_id", F.expr("episode_index * 50 + frame_index").alias("pos"))
    e = metadata.collect_episodes(f)
    return e.select("episode", F.size("states").cast("long").alias("n"), F.round(F.col("states")[0], 6).alias("first_state"), F.round(F.element_at("states", -1), 6).alias("last_state"), "prompt", "env_id")


@query("aligned_pairs", with_views(FRAMES) + "select episode_index, count(*) n, round(sum(x - px), 6) diff from v_frames where frame_index < 30 + episode_index % 5 group by 1")
def aligned_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Both trajectories up to the end of the shorter."""
    f = v_frames(spark, d)
    both = metadata.aligned(f.select("episode_index", "frame_index", "x"), f.filter("frame_index < 30 + episode_index % 5").select("episode_index", "frame_index", "px"), ["episode_index"])
    return rounded(both.groupBy("episode_index").agg(F.count("*").alias("n"), F.sum(F.col("x") - F.col("px")).alias("diff")))


@query("fewest_poses", with_views(TRACK) + "select traj_id, count(*) n from v_track group by 1")
def fewest_poses(spark: SparkSession, d: str) -> DataFrame:
    """Without trajectories every pose is one; here there are some, so they stay."""
    p = v_track(spark, d)
    t = p.groupBy("traj_id").agg(F.min("pose_id").alias("pose_start"), F.max("pose_id").alias("pose_end"))
    return episodes.trajectories_or_poses(t, p).select("traj_id", F.expr("pose_end - pose_start + 1").alias("n"))


@query("lone_poses", with_views(TRACK) + "select pose_id traj_id, count(*) n from v_track where traj_id = (select min(traj_id) from v_track) group by 1")
def lone_poses(spark: SparkSession, d: str) -> DataFrame:
    """Without trajectories every pose is one."""
    p = v_track(spark, d)
    first = p.join(F.broadcast(p.agg(F.min("traj_id").alias("traj_id"))), "traj_id")  # one row
    none = p.filter("false").select("traj_id", F.col("pose_id").alias("pose_start"), F.col("pose_id").alias("pose_end"))
    return episodes.trajectories_or_poses(none, first).groupBy("traj_id").agg(F.count("*").alias("n"))


@query("camera_frames", with_views(FRAMES) + """, u as (select *, px / sqrt(px * px + py * py) ux, py / sqrt(px * px + py * py) uy from v_frames)
select episode_index, frame_index, round(uy * x - ux * y, 6) right_, round(-ux * x - uy * y, 6) down, round(-z, 6) ahead,
  round(((degrees(atan2(px, py)) + 180e0) % 360e0 + 360e0) % 360e0 - 180e0, 5) phi, round(2 * atan(0.5e0 * 640 / (500 + abs(x))), 8) fov, round(500 + abs(x), 6) focal from u""")
def camera_frames(spark: SparkSession, d: str) -> DataFrame:
    """A point in the frame of a camera that looks down, the angles of a level one, and fields of view."""
    f = v_frames(spark, d)
    r = camera.nadir_rotation(F.col("px"), F.col("py"))
    at = [sum((a * F.col(c) for a, c in zip(row, "xyz", strict=True)), F.lit(0.0)) for row in r]
    _, phi, _ = camera.level_angles(F.col("px"), F.col("py"))
    fov = camera.field_of_view(F.lit(640.0), 500 + F.abs("x"))
    return f.select("episode_index", "frame_index", *[F.round(v, 6).alias(n) for v, n in zip(at, ("right_", "down", "ahead"), strict=True)], F.round(phi, 5).alias("phi"), F.round(fov, 8).alias("fov"), F.round(camera.focal_length(F.lit(640.0), fov), 6).alias("focal"))


@query("view_projection", with_views(FRAMES) + """, c as (select *, cos(pa) * x - sin(pa) * y + px cx, sin(pa) * x + cos(pa) * y + py cy, z + pz + 4 cz from v_frames)
select episode_index, frame_index, round(cx / tan(0.4e0) / (cz + 0.0000001e0), 6) u, round(cy / tan(0.3e0) / (cz + 0.0000001e0), 6) v, round((100e0 / 99.9e0 * cz - 10e0 / 99.9e0) / (cz + 0.0000001e0), 6) depth from c""")
def view_projection(spark: SparkSession, d: str) -> DataFrame:
    """Points through a view matrix and a projection matrix, then divided by their last coordinate."""
    f = v_frames(spark, d)
    c, s, zero, one = F.cos("pa"), F.sin("pa"), F.lit(0.0), F.lit(1.0)
    view = camera.view_matrix([[c, s, zero], [-s, c, zero], [zero, zero, one]], [F.col("px"), F.col("py"), F.col("pz") + 4])
    full = camera.matrix_product(camera.projection_matrix(0.1, 100.0, F.lit(0.8), F.lit(0.6)), view)
    u, v, depth = camera.transformed(full, [F.col(k) for k in "xyz"])
    return rounded(f.select("episode_index", "frame_index", u.alias("u"), v.alias("v"), depth.alias("depth")))


def _utm_sql() -> str:
    n = camera.FLAT / (2 - camera.FLAT)
    a = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    radius, k = camera.A / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * math.sqrt(n) / (1 + n)
    east = "eta" + "".join(f" + {v!r}e0 * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(a, 1)).replace("e-", "E-")
    north = "xi" + "".join(f" + {v!r}e0 * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(a, 1)).replace("e-", "E-")
    fix = lambda t: t.replace("E-04e0", "E-04").replace("E-05e0", "E-05").replace("E-06e0", "E-06").replace("E-07e0", "E-07").replace("E-08e0", "E-08").replace("E-09e0", "E-09").replace("E-10e0", "E-10")
    return f""", p as (select episode_index, frame_index, radians(30.5e0 + x) la, radians(114.25e0 + y) - radians(117e0) dl from v_frames),
q as (select *, sinh(atanh(sin(la)) - {k!r}e0 * atanh({k!r}e0 * sin(la))) t from p), r as (select *, atan2(t, cos(dl)) xi, atanh(sin(dl) / sqrt(1 + t * t)) eta from q)
select episode_index, frame_index, round(500000e0 + 0.9996e0 * {radius!r}e0 * ({fix(east)}) - 100000e0, 2) east, round(0.9996e0 * {radius!r}e0 * ({fix(north)}) - 3000000e0, 2) north from r"""


@query("projected_points", with_views(FRAMES) + _utm_sql())
def projected_points(spark: SparkSession, d: str) -> DataFrame:
    """Earth-centred points to a projection, less an offset."""
    f = v_frames(spark, d)
    e, n = camera.utm(30.5 + F.col("x"), 114.25 + F.col("y"), 50)
    return f.select("episode_index", "frame_index", F.round(e - 100000.0, 2).alias("east"), F.round(n - 3000000.0, 2).alias("north"))


@query("instruction_texts", """with p as (select p_partkey, p_name label, round_even(p_partkey * 0.5e0 + 80, 0)::int h, case p_partkey % 4 when 0 then 'road' when 1 then 'small road' when 2 then 'dirt road' else 'canal' end s, case p_partkey % 3 when 0 then '左上角' when 1 then '中央' else '某处' end pos from part)
select p_partkey, 'Fly to ' || h || ' meters above the ' || label || '.' landing, 'Orbit the ' || label || ' once at ' || h || ' meters with a ' || (p_partkey % 50) || '-meter radius.' orbit, 'Inspect the ' || s || ' in the view' road, '对画面' || pos || '的田地执行测绘任务' farm, '巡视画面' || pos || '的建筑' building,
  'Turn to face the ' || label || '.|Fly to above the ' || label || '.|Descend to ' || h || ' meters above the ' || label || '.' stages, 'Move above the ' || s || '|Descend to cruise altitude|Adjust heading|Inspect along the ' || s || '|Ascend back to the original altitude' road_stages from p""")
def instruction_texts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("label"), (F.col("p_partkey") * 0.5).alias("z"), F.expr("case p_partkey % 4 when 0 then '马路' when 1 then '小马路' when 2 then '小路' else '水沟' end").alias("zh"), F.expr("case p_partkey % 3 when 0 then 'top-left' when 1 then 'center' else 'nowhere' end").alias("region"))
    label, z = F.col("label"), F.col("z")
    road = templates.road_subject(F.col("zh"))
    place = templates.place(F.col("region"), "zh")
    return p.select(
        "p_partkey",
        templates.instruction("landing", z=z, label=label).alias("landing"),
        templates.instruction("orbit_radius", z=z, label=label, radius=F.expr("p_partkey % 50")).alias("orbit"),
        templates.instruction("road", subject=road).alias("road"),
        templates.instruction("farm", "zh", place=place, subject=F.lit("田地")).alias("farm"),
        templates.instruction("building", "zh", place=place).alias("building"),
        F.array_join(templates.stage_texts("landing", z=z, label=label, clean=label), "|").alias("stages"),
        F.array_join(templates.stage_texts("road", subject=road), "|").alias("road_stages"),
    )


@query("moved_paths", "select o_orderkey, 'data/chunk-' || lpad((o_orderkey // 1000)::varchar, greatest(3, length((o_orderkey // 1000)::varchar))::int, '0') || '/episode_' || lpad(o_orderkey::varchar, greatest(6, length(o_orderkey::varchar))::int, '0') || '.parquet' path from orders")
def moved_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.moved_path(F.lit("data/chunk-007/episode_000003.parquet"), F.col("o_orderkey")).alias("path"))


@query("durations", "select l_orderkey, l_linenumber, count(*) n, min(case when s >= 3600 then (s // 3600) || 'h' || lpad((s % 3600 // 60)::varchar, 2, '0') || 'm' || lpad((s % 60)::varchar, 2, '0') || 's' else lpad((s // 60)::varchar, 2, '0') || 'm' || lpad((s % 60)::varchar, 2, '0') || 's' end) took from (select *, floor(l_partkey * 3.7e0)::bigint s from lineitem) group by 1, 2")
def durations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", templates.duration(F.col("l_partkey") * F.lit(3.7)).alias("took"))
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("took").alias("took"))


@query("parsed_vectors", "select s_suppkey, case when s_suppkey % 3 = 0 then s_suppkey * 0.5e0 end x, case when s_suppkey % 3 = 0 then -2e0 end y from supplier")
def parsed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of numbers; others have a third number, or a word."""
    raw = F.concat((F.col("s_suppkey") * F.lit(0.5)).cast("string"), F.expr("case s_suppkey % 3 when 0 then ' , -2' when 1 then ',1,2' else ',two' end"))
    v = templates.vector(raw, 2)
    return table(spark, d, "supplier").select("s_suppkey", v[0].alias("x"), v[1].alias("y"))


@query("descent_poses", "select n_name as name, i::int pose, n_nationkey * 30e0 x, greatest(2e0, 20e0 - i * 2.5e0) z from nation, range(9) r(i)")
def descent_poses(spark: SparkSession, d: str) -> DataFrame:
    """A table function in SQL: poses down to each landmark."""
    tables.register(spark)
    return spark.sql("select m.name, p.pose, p.x, p.z from {marks} m, lateral descent_poses(m.x, m.y, 20D, 2D, 2.5D) p", marks=landmarks(spark, d))


@query("distances_by_name", with_views(FRAMES) + "select episode_index, frame_index, round(sqrt((x - px) ** 2 + (y - py) ** 2), 6) plane, round(abs(x - px) + abs(y - py) + abs(z - pz), 6) city from v_frames")
def distances_by_name(spark: SparkSession, d: str) -> DataFrame:
    a, b = [F.col(c) for c in "xyz"], [F.col(c) for c in ("px", "py", "pz")]
    return rounded(v_frames(spark, d).select("episode_index", "frame_index", *[tables.distance_by_name(n)(a, b).alias(n) for n in ("plane", "city")]))


@query("scored_with_errors", with_views(FRAMES) + "select episode_index, case when episode_index % 2 = 0 then round(avg(x), 6) end score, case when episode_index % 2 = 1 then 'ValueError: no scores' end error from v_frames group by 1")
def scored_with_errors(spark: SparkSession, d: str) -> DataFrame:
    """A kernel whose failures are values: an odd episode's has no score but an error."""
    import pandas as pd

    def mean(pdf: pd.DataFrame) -> float:
        if pdf["episode_index"].iloc[0] % 2:
            raise ValueError("no scores")
        return pdf["x"].mean()

    kernel = tables.with_error(mean)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        score, error = kernel(pdf)
        return pd.DataFrame({"episode_index": [pdf["episode_index"].iloc[0]], "score": [score], "error": [error]})

    out = v_frames(spark, d).select("episode_index", "x").groupBy("episode_index").applyInPandas(run, "episode_index long, score double, error string")
    return out.select("episode_index", F.round(F.when(~F.isnan("score"), F.col("score")), 6).alias("score"), "error")


@query("transform_chain", with_views(FRAMES) + "select episode_index, count(*) n, round(sum(x), 6) sx from v_frames where frame_index < 20 and frame_index % 2 = 0 group by 1")
def transform_chain(spark: SparkSession, d: str) -> DataFrame:
    run = metadata.pipeline(lambda f: evaluate.limited(f, 20, 2), lambda f: f.groupBy("episode_index").agg(F.count("*").alias("n"), F.sum("x").alias("sx")), rounded)
    return run(v_frames(spark, d))


@query("stage_ranges", "with r as (select n_name as name, k from nation, range(2) g(k)) select row_number() over (order by name, k) - 1 traj_id, 3::bigint n, true ordered from r")
def stage_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The stages of each landing follow one another and cover its poses; with placeholders all are listed."""
    paths = generators.landing(landmarks(spark, d), per=2)
    r = generators.stage_ranges(paths, 3, placeholders=True)
    whole = generators.poses(paths).groupBy("traj_id").agg(F.min("pose_id").alias("lo"), F.max("pose_id").alias("hi"))
    g = r.groupBy("traj_id").agg(F.count("*").alias("n"), F.min("pose_start").alias("s"), F.max("pose_end").alias("e"), F.sum(F.when(F.col("is_placeholder"), 0).otherwise(F.expr("pose_end - pose_start + 1"))).alias("c"))
    return g.join(whole, "traj_id").select("traj_id", "n", ((F.col("s") == F.col("lo")) & (F.col("e") == F.col("hi")) & (F.col("c") == F.expr("hi - lo + 1"))).alias("ordered"))


@query("grouped_extents", with_views(TRACK, STAGES) + "select env_id, min(pose_start) pose_start, max(pose_end) pose_end from v_stage group by 1")
def grouped_extents(spark: SparkSession, d: str) -> DataFrame:
    return stages.extents(v_stage(spark, d), ["env_id"])
