"""Queries over names, cameras, paths, meshes and generators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.functions import camera, text
from skytrail.operators import generators, geometry
from skytrail.operators import outlines as kernels
from skytrail.plans.catalog import query
from skytrail.plans.evaluation import MESH, rounded, scene_mesh, sql_wrap
from skytrail.plans.views import FRAMES, TRACK, table, v_frames, v_track, with_views

EP = ["episode_index"]


@query(
    "fn_names",
    """select order_key, regexp_replace(name, '^task_', '') task, case when contains(lower(raw), 'unseen') then 'unseen' when contains(lower(raw), 'seen') then 'seen' end split,
  'episode_' || lpad(order_key::varchar, greatest(6, length(order_key::varchar))::int, '0') stem, 'chunk-' || lpad((order_key // 1000)::varchar, greatest(3, length((order_key // 1000)::varchar))::int, '0') chunk
  from (select o_orderkey order_key, 'task_' || lower(o_orderpriority) as name, case o_orderkey % 3 when 0 then 'Test_Unseen' when 1 then 'test-SEEN' else 'train' end raw from orders)""",
)
def fn_names(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), F.concat(F.lit("task_"), F.lower("o_orderpriority")).alias("name"), F.expr("case o_orderkey % 3 when 0 then 'Test_Unseen' when 1 then 'test-SEEN' else 'train' end").alias("raw"))
    return o.select("order_key", text.task_name("name").alias("task"), text.split_name("raw").alias("split"), text.episode_stem("order_key").alias("stem"), text.chunk_dir("order_key").alias("chunk"))


@query(
    "fn_rollout_path",
    """select p_partkey, 'farm' task, case when p_partkey % 2 = 0 then 'unseen' else 'seen' end split, 'env_' || (p_partkey % 7)::varchar env from part""",
)
def fn_rollout_path(spark: SparkSession, d: str) -> DataFrame:
    model = F.when(F.expr("p_partkey % 3 = 0"), "OpenVLA/").otherwise("")
    part = F.when(F.expr("p_partkey % 2 = 0"), "test_unseen/").otherwise("test_seen/")
    path = F.concat(F.lit("/out/task_farm/"), part, model, F.lit("env_"), F.expr("p_partkey % 7").cast("string"), F.lit("/episode_3/traj.npz"))
    task, split, env = text.rollout_path(path)
    return table(spark, d, "part").select("p_partkey", task.alias("task"), split.alias("split"), env.alias("env"))


@query("fn_number_list", "select s_suppkey, s_suppkey::varchar || case when s_suppkey % 2 = 0 then '.0 2.5' else '.0 0.25' end ns from supplier where s_suppkey > 0")
def fn_number_list(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.expr("s_suppkey % 2 = 0"), F.concat(F.col("s_suppkey").cast("string"), F.lit("，2.5; x -1 2.5"))).otherwise(F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit(" 0.25,0 0.25")))
    return table(spark, d, "supplier").filter("s_suppkey > 0").select("s_suppkey", F.array_join(F.transform(text.number_array(raw), lambda v: v.cast("string")), " ").alias("ns"))


@query("natural_order", "select file, row_number() over (order by block, id) - 1 as position from (select 'Block' || (s_suppkey % 12)::varchar || '/part' || s_suppkey::varchar || '.ply' file, s_suppkey % 12 block, s_suppkey id from supplier)")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    f = table(spark, d, "supplier").select(F.concat(F.lit("Block"), F.expr("s_suppkey % 12").cast("string"), F.lit("/part"), F.col("s_suppkey").cast("string"), F.lit(".ply")).alias("file"))
    return f.select("file", (F.row_number().over(Window.orderBy(text.natural_key("file"))) - 1).cast("long").alias("position"))


@query(
    "fn_region_text",
    with_views(FRAMES)
    + """, r as (select episode_index, frame_index, case when u < 0.3e0 / 3 then 'left' when u < 0.6e0 / 3 then 'center' else 'right' end x, case when v < 0.3e0 / 3 then 'top' when v < 0.6e0 / 3 then 'center' else 'bottom' end y
  from (select *, abs(x) u, abs(y) v from v_frames)),
l as (select *, case when x = 'center' and y = 'center' then 'center' when x = 'center' then y when y = 'center' then x else y || '-' || x end region from r)
select episode_index, frame_index, region, 'Orbit the building in the ' || region || ' of the view once.' en from l""",
)
def fn_region_text(spark: SparkSession, d: str) -> DataFrame:
    f = v_frames(spark, d)
    region = text.region_label(F.abs("x"), F.abs("y"), F.lit(0.3), F.lit(0.3))
    return f.select("episode_index", "frame_index", region.alias("region"), text.orbit_text(region).alias("en"))


@query(
    "fn_subject",
    """select p_partkey, case when contains(n, 'small_road') then '小马路' when contains(n, 'lane') then '小路' when contains(n, 'ditch') then '水沟' else '马路' end road,
  'Fly above the ' || n || ' and descend to a height of ' || (round_even(p_partkey * 0.5e0 + 80, 0)::int)::varchar || ' meters.' as line from (
    select p_partkey, case p_partkey % 4 when 0 then 'old small_road lane' when 1 then 'green lane' when 2 then 'ditch 7' else 'main road' end n from part)""",
)
def fn_subject(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.expr("case p_partkey % 4 when 0 then 'old small_road lane' when 1 then 'green lane' when 2 then 'ditch 7' else 'main road' end").alias("n"))
    return p.select("p_partkey", text.subject("n", text.ROADS, "马路").alias("road"), text.landing_text(F.col("n"), F.col("p_partkey") * F.lit(0.5)).alias("line"))


@query(
    "camera_project",
    with_views(FRAMES)
    + """, r as (select *, sin(px) so, cos(px) co, sin(py) sp, cos(py) cp, sin(pz) sk, cos(pz) ck from v_frames),
c as (select *, ck * cp * x + (ck * sp * so - sk * co) * y + (ck * sp * co + sk * so) * (z + 2) cx, sk * cp * x + (sk * sp * so + ck * co) * y + (sk * sp * co - ck * so) * (z + 2) cy, -sp * x + cp * so * y + cp * co * (z + 2) cz from r)
select episode_index, frame_index, round(100 * cx / cz + 320, 5) u, round(100 * cy / cz + 240, 5) v, round(px, 6) omega, round(py, 6) phi, round(pz, 6) kappa from c""",
)
def camera_project(spark: SparkSession, d: str) -> DataFrame:
    f = v_frames(spark, d)
    o, p, k = (F.col(c) for c in ("px", "py", "pz"))
    u, v, _ = camera.project(camera.rotation(o, p, k), [F.lit(0.0), F.lit(0.0), F.lit(-2.0)], [F.col(c) for c in "xyz"], F.lit(100.0), F.lit(100.0), F.lit(320.0), F.lit(240.0))
    back = camera.angles_of(camera.world_to_camera(o, p, k))
    return f.select("episode_index", "frame_index", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"), *[F.round(a, 6).alias(n) for a, n in zip(back, ("omega", "phi", "kappa"), strict=True)])


def _ecef_sql(lat: str, lon: str, h: str) -> list[str]:
    n = f"({camera.A!r}e0 / sqrt(1 - {camera.E2!r} * sin(radians({lat})) ** 2))"
    return [f"(({n} + {h}) * cos(radians({lat})) * cos(radians({lon})))", f"(({n} + {h}) * cos(radians({lat})) * sin(radians({lon})))", f"(({n} * {1 - camera.E2!r} + {h}) * sin(radians({lat})))"]


_O = _ecef_sql("30.5e0", "114.25e0", "40e0")


@query(
    "geodesy",
    with_views(FRAMES)
    + f""", g as (select episode_index, frame_index, x * 1000 e, y * 1000 n, z * 100 u, radians(30.5e0) la, radians(114.25e0) lo from v_frames)
select episode_index, frame_index, round({_O[0]} - sin(lo) * e - sin(la) * cos(lo) * n + cos(la) * cos(lo) * u, 3) ex, round({_O[1]} + cos(lo) * e - sin(la) * sin(lo) * n + cos(la) * sin(lo) * u, 3) ey,
  round({_O[2]} + cos(la) * n + sin(la) * u, 3) ez from g""",
)
def geodesy(spark: SparkSession, d: str) -> DataFrame:
    f = v_frames(spark, d)
    p = camera.enu_to_ecef(F.col("x") * 1000.0, F.col("y") * 1000.0, F.col("z") * 100.0, F.lit(30.5), F.lit(114.25), F.lit(40.0))
    return f.select("episode_index", "frame_index", *[F.round(c, 3).alias(n) for c, n in zip(p, ("ex", "ey", "ez"), strict=True)])


@query("geodesy_round_trip", with_views(FRAMES) + "select episode_index, frame_index, round(30.5e0 + x, 7) lat, round(114.25e0 + y, 7) lon, round(z * 100, 3) h from v_frames")
def geodesy_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Geodetic to earth-centred coordinates and back gives the input."""
    f = v_frames(spark, d)
    lat, lon, h = camera.geodetic(*camera.ecef(30.5 + F.col("x"), 114.25 + F.col("y"), F.col("z") * 100.0))
    return f.select("episode_index", "frame_index", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"), F.round(h, 3).alias("h"))


@query("smooth_ring", with_views(FRAMES) + ", ring as (select episode_index, frame_index + 50 * lap i, lap, frame_index, x from v_frames, (values (-1), (0), (1)) t(lap)) select episode_index, frame_index, round(m, 6) x from (select *, avg(x) over (partition by episode_index order by i rows between 3 preceding and 2 following) m from ring) where lap = 0")
def smooth_ring(spark: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.smooth_ring(v_frames(spark, d).select(*EP, "frame_index", "x"), EP, "frame_index", ["x"], 6))


@query("smooth_open", with_views(FRAMES) + ", pad as (select episode_index, i, (select x from v_frames b where b.episode_index = a.episode_index and b.frame_index = least(greatest(i, 0), 49)) x from (select distinct episode_index from v_frames) a, range(-2, 52) r(i)) select episode_index, i frame_index, round(m, 6) x from (select *, avg(x) over (partition by episode_index order by i rows between 2 preceding and 2 following) m from pad) where i between 0 and 49")
def smooth_open(spark: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.smooth_open(v_frames(spark, d).select(*EP, "frame_index", "x"), EP, "frame_index", ["x"], 4))


@query("tangents", with_views(FRAMES) + """, t as (select *, coalesce(lead(x) over w - x, x - lag(x) over w) dx, coalesce(lead(y) over w - y, y - lag(y) over w) dy from v_frames window w as (partition by episode_index order by frame_index))
select episode_index, frame_index, round(dx / (sqrt(dx * dx + dy * dy) + 1e-8), 6) tx, round(dy / (sqrt(dx * dx + dy * dy) + 1e-8), 6) ty from t""")
def tangents(spark: SparkSession, d: str) -> DataFrame:
    return rounded(geometry.tangents(v_frames(spark, d).select(*EP, "frame_index", "x", "y"), EP, "frame_index").select(*EP, "frame_index", "tx", "ty"))


@query("drop_repeats", with_views(TRACK) + "select traj_id, sum((p is null or round(x) <> p)::int)::bigint n from (select traj_id, x, lag(round(x)) over (partition by traj_id order by pose_id) p from v_track) group by 1")
def drop_repeats(spark: SparkSession, d: str) -> DataFrame:
    pts = v_track(spark, d).groupBy("traj_id").agg(F.sort_array(F.collect_list(F.struct("pose_id", F.round("x").alias("x"), F.lit(0.0).alias("y")))).alias("p"))
    return pts.select("traj_id", F.size(geometry.drop_repeats(F.col("p"))).cast("long").alias("n"))


@query(
    "smooth_headings",
    with_views(
        FRAMES,
        """t as (select *, coalesce(lead(x) over w - x, x - lag(x) over w) dx, coalesce(lead(y) over w - y, y - lag(y) over w) dy from v_frames window w as (partition by episode_index order by frame_index)),
u as (select episode_index, frame_index, dx / (sqrt(dx * dx + dy * dy) + 1e-8) tx, dy / (sqrt(dx * dx + dy * dy) + 1e-8) ty from t),
h as (select episode_index, frame_index, tx hx, ty hy from u where frame_index = 0 union all
  select episode_index, frame_index, sx / (sqrt(sx * sx + sy * sy) + 1e-12), sy / (sqrt(sx * sx + sy * sy) + 1e-12) from (
    select u.episode_index, u.frame_index, 0.75e0 * hx + 0.25e0 * tx sx, 0.75e0 * hy + 0.25e0 * ty sy from h join u on u.episode_index = h.episode_index and u.frame_index = h.frame_index + 1))""",
        recursive=True,
    )
    + "select episode_index, frame_index, round(hx, 6) hx, round(hy, 6) hy from h",
)
def smooth_headings(spark: SparkSession, d: str) -> DataFrame:
    t = geometry.tangents(v_frames(spark, d).select(*EP, "frame_index", "x", "y"), EP, "frame_index")
    a = t.groupBy(*EP).agg(F.sort_array(F.collect_list(F.struct("frame_index", F.col("tx").alias("x"), F.col("ty").alias("y")))).alias("h"))
    h = geometry.smooth_headings(F.transform("h", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    return rounded(a.select(*EP, F.posexplode(h).alias("i", "p")).select(*EP, F.col("i").cast("long").alias("frame_index"), F.col("p.x").alias("hx"), F.col("p.y").alias("hy")))


RESAMPLED = """, a as (select *, sum(coalesce(d, 0)) over (partition by episode_index order by frame_index) s from (
  select episode_index, frame_index, x, y, sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2) d from v_frames window w as (partition by episode_index order by frame_index))),
b as (select *, lead(x) over w nx, lead(y) over w ny, lead(s) over w ns, max(s) over (partition by episode_index) total from a window w as (partition by episode_index order by frame_index)),
c as (select episode_index, x, y, nx, ny, s, ns, i * 0.05e0 t from b, range(2000) r(i) where i * 0.05e0 >= s and i * 0.05e0 < ns union all select episode_index, x, y, nx, ny, s, ns, total from b where ns = total)"""


@query("resample_path", with_views(FRAMES) + RESAMPLED + "select episode_index, row_number() over (partition by episode_index order by t) - 1 i, round(t, 5) s, round(x + (nx - x) * (t - s) / (ns - s), 5) x, round(y + (ny - y) * (t - s) / (ns - s), 5) y from c")
def resample_path(spark: SparkSession, d: str) -> DataFrame:
    out = geometry.resample(v_frames(spark, d).select(*EP, "frame_index", "x", "y"), EP, "frame_index", 0.05)
    return rounded(out.select(*EP, "i", "s", "x", "y"), 5)


@query("line_samples", with_views(FRAMES) + """, l as (select *, sqrt((px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2) len from v_frames),
s as (select *, i * 0.03e0 t from l, range(1, 1000) r(i) where i <= floor(len / 0.03e0) union all select *, -1, len from l where len - floor(len / 0.03e0) * 0.03e0 > 1e-4 or floor(len / 0.03e0) = 0)
select episode_index, frame_index, row_number() over (partition by episode_index, frame_index order by t) - 1 i, round(x + (px - x) * t / len, 5) x from s""")
def line_samples(spark: SparkSession, d: str) -> DataFrame:
    out = geometry.line_points(v_frames(spark, d), ["x", "y", "z"], ["px", "py", "pz"], 0.03, keep=["episode_index", "frame_index"])
    return out.select("episode_index", "frame_index", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


@query("turn_samples", with_views(FRAMES) + f""", t as (select *, {sql_wrap("pa * 9 - a * 9")} d from v_frames), n as (select *, greatest(1, floor(abs(degrees(d)) / 10e0)::int) n from t where abs(degrees(d)) >= 1e-3)
select episode_index, frame_index, i, round(a * 9 + d * (i / n::double), 6) yaw from n, range(1, 40) r(i) where i <= n""")
def turn_samples(spark: SparkSession, d: str) -> DataFrame:
    t = v_frames(spark, d).select("episode_index", "frame_index", F.posexplode(geometry.turn_angles(F.col("a") * 9, F.col("pa") * 9, 10.0)).alias("i", "yaw"))
    return t.select("episode_index", "frame_index", (F.col("i") + 1).cast("long").alias("i"), F.round("yaw", 6).alias("yaw"))


@query("spiral_samples", f"""with s as (select s_suppkey, greatest(1, ceil(sqrt((2 * {math.pi!r} * 3 * 20e0) ** 2 + 100e0) / 5e0)::int) n from supplier)
select s_suppkey, i, round(s_suppkey + (30e0 - 20 * (i / n::double)) * cos(6 * {math.pi!r} * (i / n::double)), 5) + 0e0 x, round(10e0 - 10 * (i / n::double), 5) z from s, range(1, 200) r(i) where i <= n""")
def spiral_samples(spark: SparkSession, d: str) -> DataFrame:
    pts = geometry.spiral_points(F.lit(0.0), F.lit(30.0), F.lit(10.0), F.lit(10.0), F.lit(0.0), 3.0, 5.0, F.col("s_suppkey").cast("double"), F.lit(0.0), True)
    s = table(spark, d, "supplier").select("s_suppkey", F.posexplode(pts).alias("i", "p"))
    return s.select("s_suppkey", (F.col("i") + 1).cast("long").alias("i"), (F.round("p.x", 5) + 0.0).alias("x"), F.round("p.z", 5).alias("z"))


@query("mesh_bounds", with_views(MESH) + "select env_id, " + ", ".join(f"round({f}({g}(ta{c}, tb{c}, tc{c})), 6) {f}_{c}" for c in "xyz" for f, g in (("min", "least"), ("max", "greatest"))) + " from tri group by 1")
def mesh_bounds(spark: SparkSession, d: str) -> DataFrame:
    t = scene_mesh(spark, d)
    v = t.select("env_id", F.explode(F.array(*[F.struct(*[F.col(f"{k}{c}").alias(c) for c in "xyz"]) for k in "abc"])).alias("v")).select("env_id", "v.*")
    return rounded(geometry.bounds(v, ["env_id"]))


@query("box_overlap", with_views(FRAMES) + """, b as (select env_id, """ + ", ".join(f"{f}({p}{c}) {f}{p}{c}" for c in "xyz" for f in ("min", "max") for p in ("", "p")) + """ from v_frames group by 1),
o as (select *, """ + ", ".join(f"greatest(least(max{c}, maxp{c}) - greatest(min{c}, minp{c}), 0e0) o{c}" for c in "xyz") + """ from b)
select env_id, round(ox, 6) overlap_x, round(oy, 6) overlap_y, round(oz, 6) overlap_z, ox * oy * oz > 0 meets, round(ox * oy * oz / least((maxx - minx) * (maxy - miny) * (maxz - minz), (maxpx - minpx) * (maxpy - minpy) * (maxpz - minpz)), 6) share from o""")
def box_overlap(spark: SparkSession, d: str) -> DataFrame:
    f = v_frames(spark, d)
    other = f.select("env_id", *[F.col(f"p{c}").alias(c) for c in "xyz"])
    return rounded(geometry.box_overlap(geometry.bounds(f, ["env_id"]), geometry.bounds(other, ["env_id"]), ["env_id"]))


@query("strip_crop", with_views(MESH) + """, s as (select env_id, """ + ", ".join(f"(t{v}x + 0.3e0) * 0.6e0 + (t{v}y + 0.4e0) * 0.8e0 s{v}, (t{v}y + 0.4e0) * 0.6e0 - (t{v}x + 0.3e0) * 0.8e0 t{v}, t{v}z z{v}" for v in "abc") + """ from tri)
select env_id, count(*) n from s where greatest(sa, sb, sc) >= -0.06e0 and least(sa, sb, sc) <= 1.06e0 and greatest(ta, tb, tc) >= -0.06e0 and least(ta, tb, tc) <= 0.06e0 and greatest(za, zb, zc) >= -0.11e0 and least(za, zb, zc) <= 0.11e0 group by 1""")
def strip_crop(spark: SparkSession, d: str) -> DataFrame:
    return geometry.strip_crop(scene_mesh(spark, d), [-0.3, -0.4, 0.0], [0.3, 0.4, 0.0], 0.05, 0.1, 0.05, 0.01).groupBy("env_id").agg(F.count("*").alias("n"))


@query("concat_blocks", """with v as (select s_nationkey block, row_number() over (partition by s_nationkey order by s_suppkey) - 1 i, s_suppkey id from supplier),
o as (select block, coalesce(sum(n) over (order by block rows between unbounded preceding and 1 preceding), 0) off from (select block, count(*) n from v group by 1))
select id, (i + off)::bigint vertex from v join o using (block)""")
def concat_blocks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    v = table(spark, d, "supplier").select(F.col("s_nationkey").alias("block"), (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).cast("long").alias("i"), F.col("s_suppkey").alias("id"))
    faces = v.select("block", "i", F.array("i").alias("idx"))
    return geometry.concat_blocks(v, faces)[0].select("id", F.col("vertex").cast("long").alias("vertex"))


@query("clean_mesh", """with f as (select l_orderkey * 10 + l_linenumber face, min(l_partkey % 997) a, min(l_suppkey % 997) b, min(l_orderkey % 997) c from lineitem group by 1),
s as (select face, list_sort(list_distinct([a, b, c])) k from f), u as (select k, min(face) face from s where len(k) = 3 group by 1),
e as (select face, unnest([(k[1], k[2]), (k[1], k[3]), (k[2], k[3])]) e from u), bad as (select e from e group by 1 having count(*) > 2)
select face from u where face not in (select face from e where e in (select e from bad))""")
def clean_mesh(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("face")).agg(*[F.min(F.expr(f"{c} % 997")).cast("long").alias(n) for c, n in (("l_partkey", "a"), ("l_suppkey", "b"), ("l_orderkey", "c"))])
    return geometry.clean_mesh(f.select("face", F.array("a", "b", "c").alias("idx"))).select("face")


@query("decimate_blocks", """select n_nationkey block, 2 * (8 + n_nationkey % 5) * (8 + n_nationkey % 5) n_faces,
greatest(4, floor(2 * (8 + n_nationkey % 5) * (8 + n_nationkey % 5) * 0.25)::bigint) target, true reached, true inside from nation""")
def decimate_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A hilly square of 8 to 12 cells a side for each nation, a quarter of its faces kept, none outside.
    A merged edge takes two faces with it, so the last may go one below the target."""
    n = F.col("n_nationkey").cast("long")
    cells = table(spark, d, "nation").select(n.alias("block"), (8 + n % 5).alias("n"))
    c = F.col("n") + 1
    v = cells.select("block", "n", F.explode(F.sequence(F.lit(0).cast("long"), c * c - 1)).alias("i"))
    v = v.select("block", "i", (F.col("i") % c).cast("double").alias("x"), F.floor(F.col("i") / c).cast("double").alias("y"))
    v = v.withColumn("z", F.sin(F.col("x") + F.col("block")) * F.cos(F.col("y") * 0.7))
    f = cells.select("block", "n", F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("n") * F.col("n") - 1)).alias("face"))
    at = (F.floor(F.col("face") / 2 / F.col("n")) * c + F.floor(F.col("face") / 2) % F.col("n")).cast("long")
    f = f.withColumn("idx", F.when(F.col("face") % 2 == 0, F.array(at, at + 1, at + c)).otherwise(F.array(at + 1, at + c + 1, at + c)))
    tri = kernels.decimate_blocks(v, f, 0.25).groupBy("block").agg(F.count("*").alias("n_triangles"), F.max(F.greatest(*[F.col(f"{p}{a}") for p in "abc" for a in "xy"])).alias("hi"))
    sizes = f.groupBy("block", "n").agg(F.count("*").alias("n_faces"))
    target = F.greatest(F.lit(4), F.floor(F.col("n_faces") * 0.25))
    return sizes.join(tri, "block").select("block", "n_faces", target.alias("target"), F.col("n_triangles").between(target - 1, target).alias("reached"), (F.col("hi") < F.col("n") + 0.5).alias("inside"))


def landmarks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 30.0).alias("x"), (F.col("n_regionkey") * 40.0).alias("y"))


def outlines(spark: SparkSession, d: str) -> DataFrame:
    """An irregular closed outline for each nation."""
    angle = lambda i: i * (2 * math.pi / 8)
    pts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct((F.col("x") + (20 + 5 * (i % 3)) * F.cos(angle(i))).alias("x"), (F.col("y") + (15 + 4 * (i % 2)) * F.sin(angle(i))).alias("y")))
    return landmarks(spark, d).select("name", pts.alias("pts"), F.lit(12.0).alias("target_z"))


def _generated(paths: DataFrame, stages: int) -> DataFrame:
    ranges = generators.stage_ranges(paths, stages)
    p = generators.poses(paths)
    per = p.groupBy("traj_id").agg(F.count("*").alias("n_poses"), F.min("pose_id").alias("pose_start"), F.max("pose_id").alias("pose_end"), F.round(F.min("z"), 4).alias("z_min"), F.round(F.max("z"), 4).alias("z_max"), *[F.round(F.max_by(c, "pose_id"), 4).alias(f"last_{c}") for c in "xy"])
    return per.join(ranges.groupBy("traj_id").agg(F.count("*").alias("n_stages"), F.sum(F.expr("pose_end - pose_start + 1")).alias("covered")), "traj_id")


def _u(draw: str) -> str:
    return f"(('0x' || substr(md5('42|{draw}|' || name || '|' || k), 1, 13))::bigint / 4503599627370496e0)"


def _turned(a: str, b: str) -> str:
    """Poses of a turn from a to b in steps of five degrees."""
    d = f"(abs(({_wrapped(f'({b}) - ({a})')})) * {180 / math.pi!r}e0)"
    return f"(case when {d} < 1e-3 then 0 else greatest(1, floor({d} / 5e0 + 1e-9)::bigint) end)"


def _wrapped(a: str) -> str:
    m = f"(({a}) + {math.pi!r}e0) % {2 * math.pi!r}e0"
    return f"(case when {m} < 0 then ({m} + {2 * math.pi!r}e0) % {2 * math.pi!r}e0 else {m} end - {math.pi!r}e0)"


def _flown(length: str) -> str:
    return f"(floor({length})::bigint + (floor({length}) = 0 or {length} - floor({length}) > 1e-4)::bigint)"


_MARKS = "with marks as (select n_name as name, n_nationkey * 30e0 x, n_regionkey * 40e0 y from nation),\n"


def _numbered(stages: int, z_min: str, last: tuple[str, str]) -> str:
    counts = [f"n{i}" for i in range(stages)]
    total = " + ".join(counts)
    return f"""select row_number() over w - 1 traj_id, {total} n_poses, (sum({total}) over w - ({total}))::bigint pose_start, (sum({total}) over w - 1)::bigint pose_end,
  round({z_min}, 4) z_min, round(z0, 4) z_max, round({last[0]}, 4) last_x, round({last[1]}, 4) last_y, {" + ".join(f"({c} > 0)::bigint" for c in counts)} n_stages, ({total})::bigint covered from n window w as (order by name, k rows unbounded preceding)"""


def _landing_sql() -> str:
    return (
        _MARKS
        + f"""t as (select *, 60e0 * sqrt({_u("r")}) r, {2 * math.pi!r}e0 * {_u("theta")} theta, 80e0 + 20e0 * {_u("z")} z0, {2 * math.pi!r}e0 * {_u("yaw")} yaw0, [-20e0, -10e0, 0e0][(floor({_u("end")} * 3) + 1)::int] z1 from marks, range(15) g(k)),
p as (select *, x + r * cos(theta) x0, y + r * sin(theta) y0 from t),
q as (select *, case when r < 1e-6 then yaw0 else atan2(y - y0, x - x0) end yaw1, sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) len from p),
n as (select *, {_turned("yaw0", "yaw1")} n0, {_flown("len")} n1, {_flown("(z0 - z1)")} n2 from q)
"""
        + _numbered(3, "z1", ("x", "y"))
    )


def _orbit_sql(per: int = 9, radius: str = "20e0", end_radius: str = "radius", turns: float = 1.0, z1: float = -20.0, z2: float = -20.0) -> str:
    return (
        _MARKS
        + f"""s as (select *, {radius} radius, {_u("theta")} ut, {_u("r")} ur, 80e0 + 20e0 * {_u("z")} z0, {2 * math.pi!r}e0 * {_u("yaw")} yaw0 from marks, range({per}) g(k)),
t as (select *, greatest(60e0, radius + 2e0) far, {2 * math.pi!r}e0 * ut theta from s),
p as (select *, sqrt((radius + 1) * (radius + 1) + ur * (far * far - (radius + 1) * (radius + 1))) r, theta - {2 * math.pi!r}e0 * {turns}e0 out_angle from t),
q as (select *, x + r * cos(theta) x0, y + r * sin(theta) y0, x + radius * cos(theta) x1, y + radius * sin(theta) y1, x + {end_radius} * cos(out_angle) x2, y + {end_radius} * sin(out_angle) y2 from p),
n as (select *, {_turned("yaw0", _wrapped(f"theta + {math.pi!r}e0"))} n0, {_flown(f"sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + ({z1}e0 - z0) * ({z1}e0 - z0))")} n1,
  {_turned(_wrapped(f"theta + {math.pi!r}e0"), _wrapped(f"theta - {math.pi / 2!r}e0"))} n2,
  greatest(1, ceil(sqrt(({2 * math.pi!r}e0 * {turns}e0 * (radius + {end_radius}) / 2) ** 2 + ({z2 - z1}e0) ** 2))::bigint) n3,
  {_turned(_wrapped(f"atan2(y2 - y, x2 - x) - {math.pi / 2!r}e0"), "atan2(y0 - y2, x0 - x2)")} n4,
  {_flown(f"sqrt((x0 - x2) * (x0 - x2) + (y0 - y2) * (y0 - y2) + (z0 - {z2}e0) * (z0 - {z2}e0))")} n5 from q)
"""
        + _numbered(6, f"{min(z1, z2)}e0", ("x0", "y0"))
    )


@query("generate_landing", _landing_sql())
def generate_landing(spark: SparkSession, d: str) -> DataFrame:
    return _generated(generators.landing(landmarks(spark, d)), 3)


@query("generate_orbit_fixed", _orbit_sql())
def generate_orbit_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _generated(generators.orbit(landmarks(spark, d)), 6)


@query("generate_orbit_radii", _orbit_sql(radius=f"[20e0, 40e0, 60e0][(floor({_u('radius')} * 3) + 1)::int]"))
def generate_orbit_radii(spark: SparkSession, d: str) -> DataFrame:
    return _generated(generators.orbit(landmarks(spark, d), radii=(20.0, 40.0, 60.0)), 6)


@query("generate_spiral", _orbit_sql(5, "30e0", "10e0", 3.0, 0.0, -20.0))
def generate_spiral(spark: SparkSession, d: str) -> DataFrame:
    return _generated(generators.orbit(landmarks(spark, d), per=5, radius=30.0, end_radius=10.0, turns=3.0, end_height=0.0, last_height=-20.0), 6)


@query("generate_building")
def generate_building(spark: SparkSession, d: str) -> DataFrame:
    return _generated(generators.from_outlines(outlines(spark, d), 4, 42, generators.inspect_building), 6)


@query("generate_road")
def generate_road(spark: SparkSession, d: str) -> DataFrame:
    return _generated(generators.from_outlines(outlines(spark, d), 2, 42, generators.both_ways(generators.follow_road)), 5)


@query("generate_field")
def generate_field(spark: SparkSession, d: str) -> DataFrame:
    return _generated(generators.from_outlines(outlines(spark, d), 4, 42, generators.map_field), 4)


@query("generate_traversal")
def generate_traversal(spark: SparkSession, d: str) -> DataFrame:
    """From one side of a wall of two triangles to the other."""
    pairs = table(spark, d, "region").select(F.lit("env").alias("env_id"), F.col("r_name").alias("name"), F.lit(0).alias("k"), *[F.lit(float(v)).alias(c) for c, v in (("sx", 0), ("sy", 0), ("sz", 10), ("gx", 40))], (F.col("r_regionkey") * 2.0).alias("gy"), F.lit(10.0).alias("gz"))
    wall = spark.createDataFrame([("env", 20.0, -8.0, 0.0, 20.0, 8.0, 0.0, 20.0, 8.0, 30.0), ("env", 20.0, -8.0, 0.0, 20.0, 8.0, 30.0, 20.0, -8.0, 30.0)], "env_id string, " + ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz"))
    return _generated(generators.from_pairs(pairs, wall), 2)


@query(
    "cut_corners",
    with_views(FRAMES)
    + """, c as (select *, lead(x) over w nx, lead(y) over w ny, lead(z) over w nz from v_frames window w as (partition by episode_index order by frame_index)),
p as (select episode_index, 0 i, x, y, z from c where frame_index = 0 union all select episode_index, 2 * frame_index + 1, 0.75e0 * x + 0.25e0 * nx, 0.75e0 * y + 0.25e0 * ny, 0.75e0 * z + 0.25e0 * nz from c where nx is not null
  union all select episode_index, 2 * frame_index + 2, 0.25e0 * x + 0.75e0 * nx, 0.25e0 * y + 0.75e0 * ny, 0.25e0 * z + 0.75e0 * nz from c where nx is not null union all select episode_index, 2 * frame_index + 1, x, y, z from c where nx is null)
select episode_index, i, round(x, 6) x, round(y, 6) y, round(z, 6) z from p""",
)
def cut_corners(spark: SparkSession, d: str) -> DataFrame:
    a = v_frames(spark, d).groupBy(*EP).agg(F.sort_array(F.collect_list(F.struct("frame_index", "x", "y", "z"))).alias("p"))
    q = geometry.cut_corners(F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))), 1)
    return rounded(a.select(*EP, F.posexplode(q).alias("i", "q")).select(*EP, F.col("i").cast("long").alias("i"), "q.x", "q.y", "q.z"))
