"""Queries that build episodes, stages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.functions import angles
from skytrail.operators import episodes, metadata, stages
from skytrail.plans.catalog import query
from skytrail.plans.evaluation import rounded, sql_wrap
from skytrail.plans.views import EPISODES, FRAMES, STAGES, TRACK, table, v_episode, v_frames, v_stage, v_track, with_views

KEYS = ["env_id", "traj_id"]
BASE = (TRACK, EPISODES)


def poses(spark: SparkSession, d: str) -> DataFrame:
    """float32 states, as they are recorded."""
    t = v_track(spark, d)
    return t.select(*KEYS, "pose_id", *[angles.float32(c).alias(c) for c in "xyz"], angles.float32(F.radians(angles.wrap_deg("kappa"))).alias("a"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    return episodes.frames_of(v_episode(spark, d), poses(spark, d), KEYS)


JOINED = """ep_frames as (
  select e.traj_id, e.env_id, e.pose_start, t.pose_id - e.pose_start frame_index, t.x::float::double x, t.y::float::double y, t.z::float::double z,
         radians((((t.kappa + 180e0) % 360e0 + 360e0) % 360e0) - 180e0)::float::double a
  from v_episode e join v_track t on t.traj_id = e.traj_id and t.pose_id between e.pose_start and e.pose_end)"""
ACTIONS = f"""acts as (
  select *, coalesce(nx - x, 0e0) dx, coalesce(ny - y, 0e0) dy, coalesce(nz - z, 0e0) dz, case when na is null then 0e0 else {sql_wrap("na - a")} end dyaw from (
    select *, lead(x) over w nx, lead(y) over w ny, lead(z) over w nz, lead(a) over w na from ep_frames
    window w as (partition by traj_id, pose_start order by frame_index)))"""
EPISODE = ["traj_id", "pose_start"]


@query("episode_frames", with_views(*BASE, JOINED) + "select traj_id, pose_start, frame_index, x, y, z, round(a, 5) a from ep_frames")
def episode_frames(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select(*EPISODE, "frame_index", "x", "y", "z", F.round("a", 5).alias("a"))


@query("episode_actions", with_views(*BASE, JOINED, ACTIONS) + "select traj_id, pose_start, frame_index, round(dx, 5) dx, round(dy, 5) dy, round(dz, 5) dz, round(dyaw, 5) dyaw from acts")
def episode_actions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(episodes.actions(frames(spark, d), EPISODE).select(*EPISODE, "frame_index", "dx", "dy", "dz", "dyaw"), 5)


@query("state_roll_forward", with_views(*BASE, JOINED, ACTIONS) + f"""select traj_id, pose_start, frame_index, round(first_value(x) over w + coalesce(sum(dx) over b, 0), 4) rx,
  round({sql_wrap("first_value(a) over w + coalesce(sum(dyaw) over b, 0)")}, 4) ra from acts
  window w as (partition by traj_id, pose_start order by frame_index), b as (partition by traj_id, pose_start order by frame_index rows between unbounded preceding and 1 preceding)""")
def state_roll_forward(spark: SparkSession, d: str) -> DataFrame:
    return episodes.roll_forward(episodes.actions(frames(spark, d), EPISODE), EPISODE).select(*EPISODE, "frame_index", F.round("rx", 4).alias("rx"), F.round("ra", 4).alias("ra"))


@query("trajectory_poses", with_views(*BASE) + "select e.traj_id, e.pose_start, count(*) n from v_episode e join v_track t on t.traj_id = e.traj_id and t.pose_id between e.pose_start and e.pose_end where t.pose_id % 9 <> 4 group by 1, 2")
def trajectory_poses(spark: SparkSession, d: str) -> DataFrame:
    """Missing poses are skipped, trajectories without any are left out."""
    some = poses(spark, d).filter("pose_id % 9 <> 4")
    return episodes.frames_of(v_episode(spark, d), some, KEYS, strict=False).groupBy(*EPISODE).agg(F.count("*").alias("n"))


@query("encode_tasks", "select event_type task, row_number() over (order by min(event_id)) - 1 task_index from events group by 1")
def encode_tasks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("task"), "event_id")
    return episodes.first_appearance(e, ["task"], ["event_id"])


@query("renumber_episodes", with_views(*BASE) + "select traj_id, pose_start, row_number() over w - 1 episode_index, coalesce(sum(length) over (order by traj_id, pose_start rows between unbounded preceding and 1 preceding), 0)::bigint frame_offset from v_episode window w as (order by traj_id, pose_start)")
def renumber_episodes(spark: SparkSession, d: str) -> DataFrame:
    return episodes.renumber(v_episode(spark, d), EPISODE).select(*EPISODE, "episode_index", "frame_offset")


MERGE = """src as (select *, (traj_id % 3)::int source from v_episode),
tasks as (select instruction, row_number() over (order by min((source, traj_id, pose_start))) - 1 task_index from src group by 1)"""


@query("merge_sources", with_views(*BASE, MERGE) + "select traj_id, pose_start, source, task_index, row_number() over (order by source, traj_id, pose_start) - 1 episode_index, coalesce(sum(length) over (order by source, traj_id, pose_start rows between unbounded preceding and 1 preceding), 0)::bigint frame_offset from src join tasks using (instruction)")
def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    e = v_episode(spark, d)
    merged, _ = episodes.merge([e.filter(F.expr(f"traj_id % 3 = {i}")) for i in range(3)], EPISODE, ["instruction"])
    return merged.select(*EPISODE, "source", "task_index", "episode_index", "frame_offset")


@query("shard_order", with_views(*BASE) + "select traj_id, pose_start, row_number() over (order by i % 16, i) - 1 as position from (select *, row_number() over (order by traj_id, pose_start) - 1 i from v_episode)")
def shard_order(spark: SparkSession, d: str) -> DataFrame:
    e = v_episode(spark, d).withColumn("_key", F.struct(*EPISODE))
    return episodes.shard_order(e, 16, "_key").select(*EPISODE, "position")


@query(
    "split_episodes",
    with_views(*BASE)
    + """select traj_id, pose_start, case when env_id = 'env_4' then 'test_unseen' when r <= round_even(n * 0.9e0, 0) then 'train' else 'test_seen' end split
  from (select *, row_number() over (partition by env_id order by md5('42|' || env_id || '|' || traj_id || '|' || pose_start), traj_id, pose_start) r, count(*) over (partition by env_id) n from v_episode)""",
)
def split_episodes(spark: SparkSession, d: str) -> DataFrame:
    return episodes.split(v_episode(spark, d), ["env_4"]).select(*EPISODE, "split")


@query("horizon_chunks", with_views(*BASE, JOINED, ACTIONS) + "select traj_id, pose_start, frame_index, len(c) n, round(list_sum(c), 4) total from (select *, list(dx) over (partition by traj_id, pose_start order by frame_index rows between current row and 9 following) c from acts)")
def horizon_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = episodes.horizon(episodes.actions(frames(spark, d), EPISODE), EPISODE, ["dx"], 10)
    total = F.aggregate("dx_chunk", F.lit(0.0), lambda a, x: a + x)
    return out.select(*EPISODE, "frame_index", F.size("dx_chunk").cast("long").alias("n"), F.round(total, 4).alias("total"))


@query("monotone_order", "select user_id, coalesce(bool_and(ts >= l), true) monotone from (select user_id, ts, lag(ts) over (partition by user_id order by event_id) l from events) group by 1")
def monotone_order(spark: SparkSession, d: str) -> DataFrame:
    return episodes.is_monotone(table(spark, d, "events"), ["user_id"], ["event_id"], "ts")


@query("episode_statistics", with_views(*BASE, JOINED) + " union all ".join(f"select traj_id, pose_start, '{c}' feature, round(min({c}), 5) min, round(max({c}), 5) max, round(avg({c}), 5) mean, round(stddev_pop({c}), 5) std, count({c}) count from ep_frames group by 1, 2" for c in "xyz"))
def episode_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(episodes.episode_stats(frames(spark, d), EPISODE, ["x", "y", "z"]), 5)


@query("normalized_states", with_views(FRAMES) + "select episode_index, frame_index, round((x - m) / (s + 1e-6), 5) x from v_frames, (select avg(x) m, stddev_pop(x) s from v_frames)")
def normalized_states(spark: SparkSession, d: str) -> DataFrame:
    return episodes.normalized(v_frames(spark, d), ["x"]).select("episode_index", "frame_index", F.round("x", 5).alias("x"))


OVER = """over_ as (
  select e.traj_id, e.env_id, e.pose_start, e.pose_end, e.length, subtask_id, text, greatest(s.pose_start, e.pose_start) stage_start, least(s.pose_end, e.pose_end) stage_end
  from v_episode e join v_stage s on s.traj_id = e.traj_id and s.pose_start <= e.pose_end and s.pose_end >= e.pose_start)"""


@query("stage_overlap", with_views(*BASE, STAGES, OVER) + "select traj_id, pose_start, subtask_id, stage_start - pose_start frame_start, stage_end - pose_start frame_end, text from over_")
def stage_overlap(spark: SparkSession, d: str) -> DataFrame:
    return stages.overlaps(v_episode(spark, d), v_stage(spark, d)).select(*EPISODE, "subtask_id", "frame_start", "frame_end", "text")


@query("stage_coverage", with_views(*BASE, STAGES, OVER) + """, marks as (select traj_id, pose_start, frame, count(*) c from (select traj_id, pose_start, unnest(range(stage_start, stage_end + 1)) frame from over_) group by 1, 2, 3)
select e.traj_id, e.pose_start, (length - coalesce(a, 0))::bigint uncovered, coalesce(m, 0)::bigint multiply_covered
from v_episode e left join (select traj_id, pose_start, count(*) a, sum((c > 1)::int) m from marks group by 1, 2) using (traj_id, pose_start)""")
def stage_coverage(spark: SparkSession, d: str) -> DataFrame:
    return stages.cover_check(v_episode(spark, d), v_stage(spark, d), EPISODE)


@query("stage_text", with_views(*BASE, STAGES, OVER) + """, near as (select *, lag(text) over (partition by traj_id, pose_start order by subtask_id, stage_start) before from over_)
select e.traj_id, e.pose_start, coalesce(t, e.instruction) as text from v_episode e left join (
  select traj_id, pose_start, string_agg(text, ' ' order by subtask_id) t from near where before is distinct from text group by 1, 2) using (traj_id, pose_start)""")
def stage_text(spark: SparkSession, d: str) -> DataFrame:
    return stages.composed_text(v_episode(spark, d), v_stage(spark, d), EPISODE)


@query("stage_extents", with_views(TRACK, STAGES) + "select env_id, traj_id, min(pose_start) pose_start, max(pose_end) pose_end from v_stage group by 1, 2")
def stage_extents(spark: SparkSession, d: str) -> DataFrame:
    return stages.extents(v_stage(spark, d))


@query("flight_start", with_views(*BASE, JOINED, ACTIONS) + "select traj_id, pose_start, min(frame_index) filter (greatest(abs(dx), abs(dy), abs(dz)) > 1e-6) fly_start, count(*) length from acts group by 1, 2")
def flight_start(spark: SparkSession, d: str) -> DataFrame:
    return stages.flight_start(episodes.actions(frames(spark, d), EPISODE), EPISODE)


@query("turn_and_fly", with_views(*BASE, JOINED, ACTIONS) + """, f as (select traj_id, pose_start, min(frame_index) filter (greatest(abs(dx), abs(dy), abs(dz)) > 1e-6) s, count(*) n from acts group by 1, 2)
select traj_id, pose_start, 0 subtask_id, 0::bigint frame_start, s - 1 frame_end from f where s > 0 union all select traj_id, pose_start, 1, s, n - 1 from f where s is not null""")
def turn_and_fly(spark: SparkSession, d: str) -> DataFrame:
    acts = episodes.actions(frames(spark, d), EPISODE)
    moving = stages.flight_start(acts, EPISODE).filter("fly_start is not null").select(*EPISODE)
    return stages.turn_and_fly(acts.join(moving, EPISODE, "left_semi"), EPISODE)


@query("positional_zip", with_views(*BASE) + "select a.traj_id, a.pose_start, b.traj_id other, a.r - 1 as position from (select *, row_number() over (order by traj_id, pose_start) r from v_episode) a join (select *, row_number() over (order by env_id, traj_id, pose_start) r from v_episode) b using (r)")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    e = v_episode(spark, d).select("env_id", *EPISODE)
    other = e.select(F.col("traj_id").alias("other"), F.col("env_id").alias("_env"), F.col("pose_start").alias("_ps"))
    return stages.positional(e, other, EPISODE, ["_env", "other", "_ps"]).select(*EPISODE, "other", "position")


@query(
    "endpoint_match",
    with_views(FRAMES)
    + """, ends as (select episode_index, count(*) length, min(env_id) env_id, min_by(x, frame_index) fx, max_by(x, frame_index) lx from v_frames group by 1),
cand as (select episode_index * 10 candidate, env_id, length, fx + case when episode_index % 3 = 0 then 1e-3 else 1e-6 end fx, lx from ends),
pairs as (select e.episode_index, c.candidate from ends e join cand c using (env_id, length) where abs(e.fx - c.fx) <= 1e-5 and abs(e.lx - c.lx) <= 1e-5)
select e.episode_index, coalesce(n, 0) n_matches, coalesce(u > 1, false) taken, case when n = 1 and u = 1 then c end candidate from ends e
left join (select episode_index, count(*) n, min(candidate) c from pairs group by 1) using (episode_index) left join (select candidate, count(*) u from pairs group by 1) on c = candidate""",
)
def endpoint_match(spark: SparkSession, d: str) -> DataFrame:
    f = v_frames(spark, d)
    ends = f.groupBy("episode_index").agg(F.count("*").alias("length"), F.min("env_id").alias("env_id"), F.min_by("x", "frame_index").alias("fx"), F.max_by("x", "frame_index").alias("lx"))
    cand = ends.select((F.col("episode_index") * 10).alias("candidate"), "env_id", "length", (F.col("fx") + F.expr("case when episode_index % 3 = 0 then 1e-3 else 1e-6 end")).alias("fx"), "lx")
    return stages.match_endpoints(ends, cand, ["env_id", "length"], ["fx", "lx"])


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Predicted chunks: at every frame of an episode, actions made of that frame's vector."""
    e = table(spark, d, "embeddings")
    acts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.array(*[F.element_at("embedding", i * 4 + 1 + j) for j in range(4)]))
    return e.select(F.expr("vec_id div 50").alias("episode"), F.expr("vec_id % 50").alias("start_step"), acts.alias("actions"))


CHUNKS = """flat as (
  select vec_id // 50 episode, vec_id % 50 + i step, embedding[i * 4 + 1]::double dx, embedding[i * 4 + 4]::double dyaw
  from embeddings, range(8) r(i))"""


@query("chunk_average", with_views(CHUNKS) + f"select episode, step, count(*) n, round(avg(dx), 6) dx, round({sql_wrap('avg(dyaw)')}, 6) dyaw from flat group by 1, 2")
def chunk_average(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stages.averaged_chunks(chunks(spark, d)).select("episode", "step", "n", "dx", "dyaw"))


@query("valid_ids", with_views(TRACK, STAGES) + "select traj_id from (select distinct traj_id from v_track) where traj_id not in (select traj_id from v_stage where subtask_id = 1) order by 1")
def valid_ids(spark: SparkSession, d: str) -> DataFrame:
    return v_track(spark, d).select("traj_id").distinct().join(v_stage(spark, d).filter("subtask_id = 1"), "traj_id", "left_anti").orderBy("traj_id")


@query("totals", with_views(*BASE, STAGES) + "select count(*) episodes, sum(length)::bigint frames, (select count(*) from v_stage) segments from v_episode")
def totals(spark: SparkSession, d: str) -> DataFrame:
    e = v_episode(spark, d).agg(F.count("*").alias("episodes"), F.sum("length").alias("frames"))
    return e.crossJoin(F.broadcast(v_stage(spark, d).agg(F.count("*").alias("segments"))))  # one row each


@query("valid_trajectories", with_views(TRACK) + "select traj_id from v_track group by 1 having bool_and((pose_id % 50) / 100e0 <= 0.48e0 or traj_id % 2 = 0)")
def valid_trajectories(spark: SparkSession, d: str) -> DataFrame:
    """A trajectory counts only if all its frames pass."""
    f = v_track(spark, d).select("traj_id", F.expr("case when traj_id % 2 = 0 then 0D else (pose_id % 50) / 100D end").alias("rgb_black"), F.lit(None).cast("double").alias("depth_black"))
    return metadata.valid_trajectories(metadata.frame_validity(f, 0.48))
