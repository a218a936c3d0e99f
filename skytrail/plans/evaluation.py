"""Queries that score predicted against true trajectories."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.functions import angles
from skytrail.operators import evaluate
from skytrail.plans.catalog import query
from skytrail.plans.views import EPISODE, FRAMES, TRACK, table, v_frames, v_track, with_views

THRESHOLDS = [0.05, 0.1, 0.15]  # the vectors lie within about 0.4
RADIUS = 0.2


def _mod(a: str, b: str) -> str:
    return f"((({a}) % {b}) + {b}) % {b}"


PI = repr(math.pi)
TWO = repr(2 * math.pi)


def sql_wrap(a: str) -> str:
    return f"({_mod(f'{a} + {PI}e0', TWO + 'e0')} - {PI}e0)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


LENGTHS = """lens as (
  select episode_index, count(*) n, sum(sqrt((x - lx) ** 2 + (y - ly) ** 2 + (z - lz) ** 2)) gt_length,
         sum(sqrt((px - lpx) ** 2 + (py - lpy) ** 2 + (pz - lpz) ** 2)) pred_length
  from (select *, lag(x) over w lx, lag(y) over w ly, lag(z) over w lz, lag(px) over w lpx, lag(py) over w lpy, lag(pz) over w lpz
        from v_frames window w as (partition by episode_index order by frame_index)) group by 1)"""
NEAR = """near as (
  select a.episode_index, a.frame_index, min((a.x - b.px) * (a.x - b.px) + (a.y - b.py) * (a.y - b.py) + (a.z - b.pz) * (a.z - b.pz)) d2
  from v_frames a join v_frames b using (episode_index) group by 1, 2)"""
TCR = """tcr as (
  select episode_index, avg((d2 <= 0.05e0 * 0.05e0)::int::double) tcr_0, avg((d2 <= 0.1e0 * 0.1e0)::int::double) tcr_1,
         avg((d2 <= 0.15e0 * 0.15e0)::int::double) tcr_2 from near group by 1)"""
ENDS = """ends as (
  select episode_index, sqrt((max_by(x, frame_index) - max_by(px, frame_index)) ** 2 + (max_by(y, frame_index) - max_by(py, frame_index)) ** 2
         + (max_by(z, frame_index) - max_by(pz, frame_index)) ** 2) end_distance from v_frames group by 1)"""


@query("eval_path_length", with_views(FRAMES, LENGTHS) + "select episode_index, round(gt_length, 6) gt_length, round(pred_length, 6) pred_length from lens")
def eval_path_length(spark: SparkSession, d: str) -> DataFrame:
    f = v_frames(spark, d)
    return rounded(evaluate.path_length(f, out="gt_length").join(evaluate.path_length(f, cols=evaluate.PXYZ, out="pred_length"), "episode_index"))


@query("eval_coverage", with_views(FRAMES, NEAR, TCR) + "select episode_index, round(tcr_0, 6) tcr_0, round(tcr_1, 6) tcr_1, round(tcr_2, 6) tcr_2, round((tcr_0 + tcr_1 + tcr_2) / 3, 6) avg_tcr from tcr")
def eval_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.coverage(v_frames(spark, d), THRESHOLDS))


@query("eval_nearest", with_views(FRAMES, NEAR) + "select episode_index, frame_index, round(d2, 9) d2 from near")
def eval_nearest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.nearest(v_frames(spark, d)), 9)


@query("eval_success", with_views(FRAMES, ENDS) + f"select episode_index, round(end_distance, 6) end_distance, case when end_distance <= {RADIUS}e0 then 1e0 else 0e0 end sr from ends")
def eval_success(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.end_distance(v_frames(spark, d)).withColumn("sr", angles.success("end_distance", RADIUS)))


PROGRESS = """seg as (
  select *, sqrt((nx - x) ** 2 + (ny - y) ** 2 + (nz - z) ** 2) len from (
    select episode_index, frame_index, x, y, z, lead(x) over w nx, lead(y) over w ny, lead(z) over w nz,
           last_value(px) over f ex, last_value(py) over f ey, last_value(pz) over f ez
    from v_frames window w as (partition by episode_index order by frame_index),
         f as (partition by episode_index order by frame_index rows between unbounded preceding and unbounded following)) where nx is not null),
spots as (
  select *, case when len * len > 1e-12 then least(greatest(((ex - x) * (nx - x) + (ey - y) * (ny - y) + (ez - z) * (nz - z)) / (len * len), 0e0), 1e0) end t,
         sum(len) over (partition by episode_index order by frame_index) - len before, sum(len) over (partition by episode_index) total from seg),
best as (
  select *, row_number() over (partition by episode_index order by (x + t * (nx - x) - ex) ** 2 + (y + t * (ny - y) - ey) ** 2 + (z + t * (nz - z) - ez) ** 2, frame_index) r
  from spots where t is not null),
prog as (select episode_index, least(greatest((before + t * len) / total, 0e0), 1e0) nsp from best where r = 1)"""


@query("eval_progress", with_views(FRAMES, PROGRESS) + "select episode_index, round(nsp, 6) nsp from prog")
def eval_progress(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.progress(v_frames(spark, d)))


SOFT = f"""angled as (
  select *, {{0}} ta, {{1}} qa from v_frames),
costs as (
  select p.episode_index e, list(sqrt((p.px - t.x) ** 2 + (p.py - t.y) ** 2 + (p.pz - t.z) ** 2 + (0.1e0 * {{2}}) ** 2) order by p.frame_index, t.frame_index) c
  from angled p join angled t using (episode_index) group by 1),
cells as (
  select e, 0 k, list_resize([]::double[], {EPISODE}, 1e300) || [c[1]] buf, c from costs
  union all
  select e, k + 1, buf[2:{EPISODE + 1}] || [c[k + 2] + m - 0.5e0 * ln(exp((m - a) / 0.5e0) + exp((m - b) / 0.5e0) + exp((m - d) / 0.5e0))], c from (
    select *, least(a, b, d) m from (
      select *, case when (k + 1) % {EPISODE} = 0 then 1e300 else buf[{EPISODE + 1}] end a, buf[2] b, case when (k + 1) % {EPISODE} = 0 then 1e300 else buf[1] end d
      from cells where k + 1 < {EPISODE * EPISODE}))),
soft as (
  select e episode_index, buf[{EPISODE + 1}] dtw, least(greatest(exp(-buf[{EPISODE + 1}] / {3 * EPISODE}e0), 0e0), 1e0) ndtw
  from cells where k = {EPISODE * EPISODE - 1})""".format(*(sql_wrap(f"case when abs({c}) > 3.5e0 * {PI}e0 then radians({c}) else {c} end") for c in ("a", "pa")), sql_wrap("p.qa - t.ta"))


@query("eval_soft_dtw", with_views(FRAMES, SOFT, recursive=True) + "select episode_index, round(dtw, 6) dtw, (select count(*) from v_frames f where f.episode_index = soft.episode_index) num_gt, round(ndtw, 6) ndtw from soft")
def eval_soft_dtw(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.soft_dtw_scores(v_frames(spark, d)))


def scene_mesh(spark: SparkSession, d: str) -> DataFrame:
    """A triangle for every vector, in three of the four scenes."""
    return table(spark, d, "embeddings").select(F.concat(F.lit("env_"), F.expr("(vec_id div 20) % 3").cast("string")).alias("env_id"), *[F.col("embedding")[10 + 3 * i + j].cast("double").alias(v + c) for i, v in enumerate("abc") for j, c in enumerate("xyz")])


MESH = "tri as (select 'env_' || ((vec_id // 20) % 3)::varchar env_id, " + ", ".join(f"embedding[{11 + 3 * i + j}]::double t{v}{c}" for i, v in enumerate("abc") for j, c in enumerate("xyz")) + " from embeddings)"


def _cross(u: str, v: str) -> list[str]:
    return [f"({u}y * {v}z - {u}z * {v}y)", f"({u}z * {v}x - {u}x * {v}z)", f"({u}x * {v}y - {u}y * {v}x)"]


HITS = (
    """segs as (
  select episode_index, env_id, p0x, p0y, p0z, sqrt((p1x - p0x) ** 2 + (p1y - p0y) ** 2 + (p1z - p0z) ** 2) len,
         (p1x - p0x) / len dx, (p1y - p0y) / len dy, (p1z - p0z) / len dz from (
    select episode_index, env_id, px p0x, py p0y, pz p0z, lead(px) over w p1x, lead(py) over w p1y, lead(pz) over w p1z
    from v_frames window w as (partition by episode_index order by frame_index)) where p1x is not null),
m0 as (
  select s.*, """
    + ", ".join(f"tb{c} - ta{c} e{c}, tc{c} - ta{c} f{c}, p0{c} - ta{c} s{c}" for c in "xyz")
    + """ from segs s join tri using (env_id)),
m1 as (select *, """
    + ", ".join(f"{x} h{c}" for c, x in zip("xyz", _cross("d", "f"), strict=True))
    + ", "
    + ", ".join(f"{x} q{c}" for c, x in zip("xyz", _cross("s", "e"), strict=True))
    + """ from m0),
m2 as (select *, ex * hx + ey * hy + ez * hz det, sx * hx + sy * hy + sz * hz su, dx * qx + dy * qy + dz * qz sv, fx * qx + fy * qy + fz * qz st from m1),
hits as (
  select episode_index, max((abs(det) > 1e-14 and su / det >= 0 and sv / det >= 0 and su / det + sv / det <= 1
         and st / det >= -1e-8 and st / det <= len + 1e-8)::int)::double hit from m2 group by 1),
cols as (
  select episode_index, case when env_id in (select env_id from tri) then coalesce(hit, 0e0) else 'nan'::double end cr
  from (select distinct episode_index, env_id from v_frames) left join hits using (episode_index))"""
)


@query("eval_collision", with_views(FRAMES, MESH, HITS) + "select episode_index, case when isnan(cr) then null else cr end cr from cols")
def eval_collision(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.collisions(v_frames(spark, d), scene_mesh(spark, d)).select("episode_index", angles.finite("cr").alias("cr"))


SCORES = """scores as (
  select e.*, case when end_distance <= 0.2e0 then 1e0 else 0e0 end sr, gt_length / greatest(gt_length, pred_length) ratio, cr, nsp, (tcr_0 + tcr_1 + tcr_2) / 3 avg_tcr
  from ends e join lens using (episode_index) join cols using (episode_index) join prog using (episode_index) join tcr using (episode_index))"""


@query("eval_efficiency", with_views(FRAMES, MESH, HITS, LENGTHS, ENDS, NEAR, TCR, PROGRESS, SCORES) + "select episode_index, round(sr * ratio, 6) spl, case when not isnan(cr) then round(sr * ratio * (1 - cr), 6) end cspl from scores")
def eval_efficiency(spark: SparkSession, d: str) -> DataFrame:
    f = v_frames(spark, d)
    parts = evaluate.lengths(f).join(evaluate.collisions(f, scene_mesh(spark, d)), "episode_index").withColumn("sr", angles.success("end_distance", RADIUS))
    lengths = "sr", "gt_length", "pred_length"
    return parts.select("episode_index", F.round(angles.spl(*lengths), 6).alias("spl"), F.round(angles.finite(angles.spl(*lengths, "cr")), 6).alias("cspl"))


_SUMMARY = ", ".join(f"round(avg({e}) filter (not isnan({e})), 6) {n}" for n, e in (("avg_tcr", "avg_tcr"), ("nsp", "nsp"), ("sr", "sr"), ("cr", "cr"), ("spl", "sr * ratio"), ("cspl", "sr * ratio * (1 - cr)")))


@query(
    "eval_summary",
    with_views(FRAMES, MESH, HITS, LENGTHS, ENDS, NEAR, TCR, PROGRESS, SCORES, "info as (select distinct episode_index, split, task from v_frames)")
    + f"select case grouping_id(split, task) when 3 then 'overall' when 1 then 'split' else 'task' end kind, coalesce(split, task, 'all') as name, count(*) n, {_SUMMARY} from scores join info using (episode_index) group by grouping sets ((), (split), (task))",
)
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    """All scores an episode but soft-DTW, rolled up overall, by split and by task."""
    f = v_frames(spark, d)
    info = evaluate.path_scores(f, THRESHOLDS).join(evaluate.collisions(f, scene_mesh(spark, d)), "episode_index").withColumn("sr", angles.success("end_distance", RADIUS))
    info = info.withColumns({"spl": angles.spl("sr", "gt_length", "pred_length"), "cspl": angles.spl("sr", "gt_length", "pred_length", "cr")})
    return rounded(evaluate.summary(info, ["avg_tcr", "nsp", "sr", "cr", "spl", "cspl"]))


_RECORD = ["tcr_0", "tcr_1", "tcr_2", "avg_tcr", "nsp", "end_distance", "gt_length", "pred_length", "dtw", "ndtw", "sr"]


@query(
    "eval_episode_metrics",
    with_views(FRAMES, MESH, HITS, LENGTHS, ENDS, NEAR, TCR, PROGRESS, SOFT, recursive=True)
    + f""", scores as (select *, (tcr_0 + tcr_1 + tcr_2) / 3 avg_tcr, case when end_distance <= 0.2e0 then 1e0 else 0e0 end sr, gt_length / greatest(gt_length, pred_length) ratio
  from ends join lens using (episode_index) join cols using (episode_index) join prog using (episode_index) join tcr using (episode_index) join soft using (episode_index)),
info as (select episode_index, min(task) task, min(split) split, min(env_id) env_id, count(x) num_gt, count(px) num_pred from v_frames group by 1)
select episode_index, task, split, env_id, num_gt, num_pred, {", ".join(f"round({c}, 6) {c}" for c in _RECORD)}, case when not isnan(cr) then cr end cr, case when isnan(cr) then 'no mesh' end error,
  round(sr * ratio, 6) spl, case when not isnan(cr) then round(sr * ratio * (1 - cr), 6) end cspl from scores join info using (episode_index)""",
)
def eval_episode_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every score of every episode, soft-DTW included."""
    out = evaluate.episode_metrics(v_frames(spark, d), THRESHOLDS, RADIUS, triangles=scene_mesh(spark, d))
    return rounded(out.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes]))


@query("eval_first_hit", with_views(FRAMES, MESH, HITS) + ", firsts as (select episode_index, round(min(greatest(st / det, 0e0)), 6) distance, count(*) n from m2 where abs(det) > 1e-14 and su / det >= 0 and sv / det >= 0 and su / det + sv / det <= 1 and st / det >= -1e-8 and st / det <= len + 1e-8 group by 1) select episode_index, distance from firsts")
def eval_first_hit(spark: SparkSession, d: str) -> DataFrame:
    """How soon a step of an episode meets the mesh, the least over its steps."""
    return rounded(evaluate.segment_hits(evaluate.steps(v_frames(spark, d)), scene_mesh(spark, d), ["env_id"], ["episode_index"]))


@query("eval_limited", with_views(FRAMES) + "select episode_index, count(*) n, round(sum(x), 6) sx from v_frames where frame_index < 40 and frame_index % 3 = 0 group by 1")
def eval_limited(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.limited(v_frames(spark, d), 40, 3).groupBy("episode_index").agg(F.count("*").alias("n"), F.sum("x").alias("sx")))


@query(
    "eval_running_means",
    with_views(FRAMES, ENDS, SOFT, recursive=True) + ", both_ as (select * from ends join soft using (episode_index)) select episode_index, " + ", ".join(f"round(avg({c}) over w, 6) mean_{c}" for c in ("end_distance", "ndtw")) + " from both_ window w as (order by episode_index rows between unbounded preceding and current row)",
)
def eval_running_means(spark: SparkSession, d: str) -> DataFrame:
    f = v_frames(spark, d)
    return rounded(evaluate.running_means(evaluate.end_distance(f).join(evaluate.soft_dtw_scores(f), "episode_index"), ["end_distance", "ndtw"], "episode_index"))


@query(
    "fn_angles",
    with_views(TRACK)
    + f"""select traj_id, pose_id, round({sql_wrap("x")}, 6) w, round({_mod("kappa + 180e0", "360e0")} - 180e0, 6) wd,
  round({sql_wrap(f"case when abs(kappa) > 3.5e0 * {PI}e0 then radians(kappa) else kappa end")}, 6) sa,
  round(radians({_mod("(case when traj_id % 2 = 0 then phi else kappa end) + 180e0", "360e0")} - 180e0), 6) pa,
  round({sql_wrap(f"{PI}e0 / 2 - x")}, 6) ly, x::float::double f32 from v_track""",
)
def fn_angles(spark: SparkSession, d: str) -> DataFrame:
    t = v_track(spark, d).withColumn("task", F.when(F.expr("traj_id % 2 = 0"), " Obstacle ").otherwise("hl"))
    cols = {"w": angles.wrap_rad("x"), "wd": angles.wrap_deg("kappa"), "sa": angles.state_angle("kappa"), "pa": angles.pose_angle("task", "phi", "kappa"), "ly": angles.legacy_yaw("x")}
    return t.select("traj_id", "pose_id", *[F.round(v, 6).alias(k) for k, v in cols.items()], angles.float32("x").alias("f32"))


@query(
    "fn_point_cost",
    with_views(FRAMES)
    + f"""select episode_index, frame_index, round(sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2 + 0.01e0 * {sql_wrap("a - pa")} ** 2), 6) as cost,
  round(least(x, y, z) - 0.5e0 * ln(exp((least(x, y, z) - x) / 0.5e0) + exp((least(x, y, z) - y) / 0.5e0) + exp((least(x, y, z) - z) / 0.5e0)), 6) soft from v_frames""",
)
def fn_point_cost(spark: SparkSession, d: str) -> DataFrame:
    f = v_frames(spark, d)
    a, b = [F.col(c) for c in ("x", "y", "z", "a")], [F.col(c) for c in ("px", "py", "pz", "pa")]
    return f.select("episode_index", "frame_index", F.round(angles.point_cost(a, b), 6).alias("cost"), F.round(angles.softmin3(*a[:3], 0.5), 6).alias("soft"))
