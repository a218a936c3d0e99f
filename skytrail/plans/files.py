"""Queries that write files of every format to the shared folder and read them back."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skytrail.operators import episodes, evaluate
from skytrail.plans.catalog import query
from skytrail.plans.evaluation import rounded
from skytrail.plans.geometry import landmarks, outlines
from skytrail.plans.views import EPISODES, FRAMES, STAGES, TRACK, table, v_episode, v_frames, v_stage, v_track, with_views
from skytrail.sources import files, media, mesh, sinks, text
from skytrail.sources.scratch import scratch_dir

ENVS = [f"env_{i}" for i in range(5)]
INTRINSICS = {"width": 640, "height": 480, "fx": 500.5, "fy": 501.5, "cx": 320.0, "cy": 240.0}


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file."""
    root, name = path.rsplit("/", 1)
    media.write_files(spark.createDataFrame([(name, bytearray(content))], "path string, content binary"), root)


def spread(df: DataFrame) -> DataFrame:
    """Small rows that make a file each, dealt to many tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pose_files(spark: SparkSession, d: str) -> str:
    """A pose file for each scene; pose ids count on from track to track."""
    root = scratch_dir(spark, "poses")
    p = v_track(spark, d).select("env_id", F.expr("traj_id * 100000 + pose_id").alias("pose_id"), "x", "y", "z", F.lit(180.0).alias("omega"), "phi", "kappa")
    rows = p.orderBy("env_id", "pose_id").select("env_id", sinks.pose_line())
    sinks.write_line_files(spark, root, "traj_random.txt", rows, "env_id", sinks.pose_header((1.0, 2.0, 3.0), INTRINSICS), ENVS)
    return root


@query("scan_poses", with_views(TRACK) + """select env_id, traj_id * 100000 + pose_id pose_id, round(x::float::double, 4) x, round(z::float::double, 4) z,
  round(radians(((kappa + 180e0) % 360e0 + 360e0) % 360e0 - 180e0)::float::double, 4) a from v_track""")
def scan_poses(spark: SparkSession, d: str) -> DataFrame:
    s = text.states(text.read_poses(spark, f"{pose_files(spark, d)}/*/traj_random.txt"), "hl")
    return s.select("env_id", "pose_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("x", "z", "a")])


@query("scan_intrinsics", "select 'env_' || i env_id, 640e0 width, 500.5e0 fx, 240e0 cy, round(2 * atan(320e0 / 500.5e0), 9) fov_x, round(2 * atan(240e0 / 501.5e0), 9) fov_y from range(5) r(i)")
def scan_intrinsics(spark: SparkSession, d: str) -> DataFrame:
    h = text.intrinsics_of_header(spark, f"{pose_files(spark, d)}/*/traj_random.txt")
    return h.select(text.env_of(F.col("file")).alias("env_id"), "width", "fx", "cy", F.round("fov_x", 9).alias("fov_x"), F.round("fov_y", 9).alias("fov_y"))


SPLIT = """cut as (select *, case when env_id = 'env_4' then 'test_unseen' when r <= round_even(n * 0.9e0, 0) then 'train' else 'test_seen' end split
  from (select *, row_number() over (partition by env_id order by md5('42|' || env_id || '|' || traj_id || '|' || pose_start), traj_id, pose_start) r, count(*) over (partition by env_id) n from v_episode))"""


@query("scan_instructions", with_views(TRACK, EPISODES, SPLIT) + "select split, env_id, traj_id, pose_start, pose_end, 'go to  the ' || instruction instruction, length from cut")
def scan_instructions(spark: SparkSession, d: str) -> DataFrame:
    """Split files, and the episodes that they hold."""
    root = scratch_dir(spark, "splits")
    e = episodes.split(v_episode(spark, d), ["env_4"]).withColumn("instruction", F.concat(F.lit("go to  the "), "instruction"))
    sinks.write_splits(spark, root, e)
    parts = [text.read_instructions(spark, f"{root}/instruction_{s}.txt").withColumn("split", F.lit(s)) for s in ("train", "test_seen", "test_unseen")]
    out = parts[0].union(parts[1]).union(parts[2])
    return out.select("split", "env_id", "traj_id", "pose_start", "pose_end", "instruction", "length")


@query("scan_stages", with_views(TRACK, STAGES) + "select env_id, traj_id, count(*) n, string_agg(text, '|' order by pose_start, pose_end, subtask_id) texts from v_stage group by 1, 2")
def scan_stages(spark: SparkSession, d: str) -> DataFrame:
    root, s = scratch_dir(spark, "stages"), v_stage(spark, d)
    for env in ENVS:
        sinks.write_lines(spark, f"{root}/{env}/subtask.txt", sinks.stage_lines(s.filter(F.col("env_id") == env)), "# traj_id subtask_id pose_start pose_end text")
    g = text.grouped_stages(text.read_stages(spark, f"{root}/*/subtask.txt"))
    return g.select("env_id", "traj_id", F.size("stages").cast("long").alias("n"), F.array_join(F.transform("stages", lambda x: x["text"]), "|").alias("texts"))


@query("scan_trajectory_meta", with_views(TRACK, EPISODES) + "select env_id, traj_id, 'the old ' || min(instruction) as name, min(pose_start) pose_start, max(pose_end) pose_end from v_episode group by 1, 2")
def scan_trajectory_meta(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_dir(spark, "meta")
    m = v_episode(spark, d).groupBy("env_id", "traj_id").agg(F.concat(F.lit("the old "), F.min("instruction")).alias("name"), F.min("pose_start").alias("pose_start"), F.max("pose_end").alias("pose_end"))
    for env in ENVS:
        sinks.write_lines(spark, f"{root}/{env}/traj_meta.txt", sinks.meta_lines(m.filter(F.col("env_id") == env)))
    return text.read_trajectory_meta(spark, f"{root}/*/traj_meta.txt")


@query("scan_valid_ids", with_views(TRACK, EPISODES) + "select env_id, traj_id, count(*) n from v_episode where env_id not in ('env_0', 'env_1') or traj_id % 2 = 0 group by 1, 2")
def scan_valid_ids(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with a list keep what it holds, those without one keep all."""
    root, e = scratch_dir(spark, "valid"), v_episode(spark, d)
    for env in ENVS[:2]:
        ids = e.filter((F.col("env_id") == env) & (F.expr("traj_id % 2 = 0"))).select("traj_id").distinct().orderBy("traj_id")
        sinks.write_lines(spark, f"{root}/{env}/wash_res.txt", ids.select(F.col("traj_id").cast("string").alias("value")))
    return text.only_valid(e, text.read_valid_ids(spark, f"{root}/*/wash_res.txt")).groupBy("env_id", "traj_id").agg(F.count("*").alias("n"))


@query("scan_landmarks", "select lower(n_name) || ' tower' label, n_nationkey * 30e0 x, n_regionkey * 40e0 y from nation")
def scan_landmarks(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_dir(spark, "landmarks")
    rows = landmarks(spark, d).orderBy("name").select(F.concat(F.format_string("%.2f\t%.2f 0 ", "x", "y"), F.lower("name"), F.lit(" tower，")).alias("value"))
    sinks.write_lines(spark, f"{root}/env_0/marks.txt", rows, "#x y z label\nx y z skipped label")
    return text.read_landmarks(spark, f"{root}/env_0/marks.txt").select("label", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


@query("scan_polylines", "select n_name as name, case n_nationkey % 2 when 0 then 'road' else 'building' end kind, 8::bigint n, round(3.5e0 + n_nationkey, 6) target_z from nation")
def scan_polylines(spark: SparkSession, d: str) -> DataFrame:
    """Outlines and roads, a file each: repeated and closing points go, the height is the median."""
    root = scratch_dir(spark, "lines")
    o = outlines(spark, d).join(table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey"), "name")
    p = o.select("name", "n_nationkey", F.posexplode("pts").alias("i", "p")).select("name", "n_nationkey", F.concat_ws(" ", F.format_string("%.6f", "p.x"), F.format_string("%.6f", "p.y"), (F.col("i") + F.col("n_nationkey")).cast("string"), F.lit("label")).alias("line"), "i")
    lines = p.groupBy("name", "n_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda r: r["line"]).alias("l"))
    # Outlines repeat a middle line and roads come back to their first point, at middle heights, so the
    # median stays.
    again = F.regexp_replace(F.get("l", F.lit(0)), r" \d+ label$", "")
    closing = F.when(F.expr("n_nationkey % 2 = 0"), F.concat(again, F.format_string(" %.1f label", F.col("n_nationkey") + 3.5))).otherwise(F.get("l", F.lit(7)))
    text_of = F.when(F.expr("n_nationkey % 2 = 0"), F.concat_ws("\n", "l", closing)).otherwise(F.concat_ws("\n", F.slice("l", 1, 4), F.get("l", F.lit(3)), F.get("l", F.lit(4)), F.slice("l", 5, 4)))
    kind = F.when(F.expr("n_nationkey % 2 = 0"), "road").otherwise("building")
    media.write_files(lines.select(F.concat(kind, F.lit("/"), "name", F.lit(".txt")).alias("path"), F.concat(F.lit("# x y z label\n"), text_of, F.lit("\n")).cast("binary").alias("content")), root)
    parts = [text.read_polylines(spark, f"{root}/{k}", k) for k in ("road", "building")]
    return parts[0].union(parts[1]).select("name", "kind", F.size("pts").cast("long").alias("n"), F.round("target_z", 6).alias("target_z"))


@query("scan_model_metadata", "select 'm' || r_regionkey file, case when r_regionkey % 2 = 0 then 30.5e0 + r_regionkey end lat, case when r_regionkey % 2 = 1 then 32650 + r_regionkey end::int epsg, r_regionkey * 10e0 x, 3e0 z from region")
def scan_model_metadata(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_dir(spark, "srs")
    srs = F.when(F.expr("r_regionkey % 2 = 0"), F.concat(F.lit("ENU:"), (30.5 + F.col("r_regionkey")).cast("string"), F.lit(", 114.25"))).otherwise(F.concat(F.lit("EPSG:"), (32650 + F.col("r_regionkey")).cast("string")))
    xml = F.concat(F.lit("<ModelMetadata><SRS>"), srs, F.lit("</SRS><SRSOrigin>"), (F.col("r_regionkey") * 10).cast("string"), F.lit(", -2.5,3</SRSOrigin></ModelMetadata>"))
    media.write_files(table(spark, d, "region").select(F.concat(F.lit("m"), F.col("r_regionkey").cast("string"), F.lit("/metadata.xml")).alias("path"), xml.cast("binary").alias("content")), root)
    m = text.read_model_metadata(spark, f"{root}/*/metadata.xml")
    return m.select(text.env_of(F.col("file")).alias("file"), "lat", "epsg", "x", "z")


def camera_file(spark: SparkSession, d: str) -> str:
    root = scratch_dir(spark, "cameras")
    photo = F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in ("<Photo><Id>", F.col("s_suppkey").cast("string"), "</Id><ImagePath>a", F.col("s_suppkey").cast("string"), ".jpg</ImagePath><Pose><Center><x>", (F.col("s_suppkey") * 1.5).cast("string"), "</x><y>2</y><z>-3.5</z></Center></Pose></Photo>")])
    head = "<BlocksExchange><Block><Photogroups><Photogroup><ImageDimensions><Width>5280</Width><Height>3956</Height></ImageDimensions><FocalLengthPixels>3700.5</FocalLengthPixels><PrincipalPoint><x>2640</x><y>1978</y></PrincipalPoint>"
    rows = table(spark, d, "supplier").orderBy("s_suppkey").select(photo.alias("value"))
    end = spark.createDataFrame([("</Photogroup></Photogroups></Block></BlocksExchange>",)], "value string")
    sinks.write_lines(spark, f"{root}/block.xml", rows.union(end), head)
    return f"{root}/block.xml"


@query("scan_cameras", "select s_suppkey photo, 'a' || s_suppkey || '.jpg' image, s_suppkey * 1.5e0 x, -3.5e0 z from supplier")
def scan_cameras(spark: SparkSession, d: str) -> DataFrame:
    return text.read_cameras(spark, camera_file(spark, d)).select("photo", "image", "x", "z")


@query("scan_camera_block", "select 5280 width, 3956 height, 3700.5e0 fx, 3700.5e0 fy, 1978e0 cy")
def scan_camera_block(spark: SparkSession, d: str) -> DataFrame:
    return text.read_intrinsics(spark, camera_file(spark, d)).select("width", "height", "fx", "fy", "cy")


@query("scan_episode_files", with_views(FRAMES) + "select episode_index episode_id, frame_index, env_id, round(x::float::double, 6) x, round(pa::float::double, 6) act from v_frames")
def scan_episode_files(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_dir(spark, "dataset")
    f = v_frames(spark, d).select(F.array(*[F.col(c).cast("float") for c in ("x", "y", "z", "a")]).alias("state"), F.array(*[F.col(c).cast("float") for c in ("px", "py", "pz", "pa")]).alias("actions"), "env_id", "episode_index", "frame_index", F.expr("episode_index * 50 + frame_index").alias("index"), F.lit(0).cast("long").alias("task_index"))
    sinks.write_episodes(f, root)
    back = files.read_episodes(spark, root)
    return back.select("episode_id", "frame_index", "env_id", F.round(F.col("state")[0].cast("double"), 6).alias("x"), F.round(F.col("actions")[3].cast("double"), 6).alias("act"))


@query("scan_jsonl", "select s_suppkey, case when s_suppkey % 3 <> 0 then round(s_suppkey / 7e0, 6) end score, 'größe ' || s_suppkey note from supplier")
def scan_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """What is not finite is written as null; a missing file is an empty table."""
    root = scratch_dir(spark, "jsonl")
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.expr("s_suppkey % 3 <> 0"), F.round(F.col("s_suppkey") / 7.0, 6)).otherwise(float("nan")).alias("score"), F.concat(F.lit("größe "), F.col("s_suppkey").cast("string")).alias("note"))
    sinks.write_lines(spark, f"{root}/a.jsonl", sinks.json_lines(s, ["s_suppkey"]))
    schema = "s_suppkey long, score double, note string"
    return files.read_jsonl(spark, f"{root}/a.jsonl", schema).union(files.read_jsonl(spark, f"{root}/none.jsonl", schema))


@query("scan_report", with_views(FRAMES) + "select case grouping_id(split, task) when 3 then 'overall' when 1 then 'split' else 'task' end kind, coalesce(split, task, 'all') as name, count(*) n, round(avg(x), 6) m from v_frames group by grouping sets ((), (split), (task))")
def scan_report(spark: SparkSession, d: str) -> DataFrame:
    """A report of means by split and task, written as one document and read again."""
    root = scratch_dir(spark, "report")
    s = evaluate.summary(v_frames(spark, d).select("split", "task", F.col("x").alias("m")), ["m"])
    put(spark, f"{root}/report.json", sinks.report(rounded(s)).encode())
    doc = files.read_json(spark, f"{root}/report.json")
    return spark.createDataFrame([(kind, name, r["n"], r["m"]) for kind, names in doc.items() for name, r in names.items()], "kind string, name string, n long, m double")


@query("scan_rollouts", with_views(FRAMES) + """select 'task_' || (episode_index % 3) || '/' || split || '/' || env_id || '/episode_' || episode_index path_of, (episode_index % 3)::varchar task, split, env_id, frame_index,
  round(x::float::double, 6) x, case when frame_index < 45 then round(pa::float::double, 6) end pa from v_frames""")
def scan_rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of NPZ arrays of unequal lengths; task, split and scene come from their paths."""
    root = scratch_dir(spark, "rollouts")
    f = v_frames(spark, d)
    f = f.withColumns({c: F.when(F.col("frame_index") < 45, F.col(c)) for c in ("px", "py", "pz", "pa")})
    where = F.concat("task", F.lit("/test_"), "split", F.lit("/"), "env_id", F.lit("/episode_"), F.col("episode_index").cast("string"))
    media.write_files(media.rollout_files(f, "episode_index", F.concat(where, F.lit("/traj_gt_pred_xyzk.npz"))), root)
    back = files.read_rollouts(spark, root)
    at = F.regexp_replace(F.regexp_extract("path", r"(task_.*)/[^/]+$", 1), "/test_", "/")
    return back.select(at.alias("path_of"), "task", "split", "env_id", "frame_index", F.round("x", 6).alias("x"), F.round("pa", 6).alias("pa"))


@query("scan_ply", "select s_suppkey % 3 block, row_number() over (partition by s_suppkey % 3 order by s_suppkey) - 1 i, round((s_suppkey * 0.1e0)::float::double, 5) x, (s_suppkey % 200)::double red, round((s_suppkey * 2e0)::float::double, 5) scale_0 from supplier")
def scan_ply(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of vertices with all their properties, as text and binary files with faces."""
    root = scratch_dir(spark, "ply")
    mesh.register(spark)
    v = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 0.1).alias("x"), (F.col("s_suppkey") * 0.2).alias("y"), F.lit(1.5).alias("z"), F.expr("s_suppkey % 200").alias("red"), (F.col("s_suppkey") * 2.0).alias("scale_0"))
    types = {"x": "float", "y": "float", "z": "float", "red": "uchar", "scale_0": "float"}
    faces = spark.createDataFrame([(0, [0, 1, 2])], "face long, idx array<int>")
    for b in range(3):
        mesh.write_ply(spark, f"{root}/Block{b}.ply", v.filter(F.expr(f"s_suppkey % 3 = {b}")), "s_suppkey", types, faces, text=b == 1)
    back = spark.read.format("ply").load(f"{root}/*.ply")
    return back.select(F.col("block").cast("long").alias("block"), "i", *[F.round(c, 5).alias(c) for c in ("x", "red", "scale_0")])


@query("scan_obj", """select 'v' kind, s_suppkey - (select min(s_suppkey) from supplier) i, round(s_suppkey * 0.25e0, 5) x, null::bigint corner from supplier
union all select 'f', 0, null, (select count(*) from supplier) - 1 union all select 'f', 1, null, 2""")
def scan_obj(spark: SparkSession, d: str) -> DataFrame:
    """Vertices and faces of a mesh file; a negative index counts back from the vertices so far."""
    root = scratch_dir(spark, "obj")
    mesh.register(spark)
    w = Window.orderBy("s_suppkey")
    v = table(spark, d, "supplier").select((F.row_number().over(w) - 1).alias("vertex"), (F.col("s_suppkey") * 0.25).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"))
    n = v.count()
    faces = spark.createDataFrame([(0, [0, 1, n - 1]), (1, [0, 1, 2])], "face long, idx array<long>")
    lines = sinks_obj(v, faces)
    sinks.write_lines(spark, f"{root}/mesh.obj", lines.unionAll(spark.createDataFrame([("f 1 2",)], "value string")))
    back = spark.read.format("obj").load(f"{root}/mesh.obj")
    return back.select("kind", "i", F.round("x", 5).alias("x"), F.get("idx", F.lit(2)).alias("corner"))


def sinks_obj(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Lines of the mesh, the first face by an index from the end."""
    return mesh.obj_lines(vertices, faces).select(F.when(F.col("value").startswith("f 1 2 ") & (F.col("value") != "f 1 2 3"), "f 1/5/5 2//2 -1").otherwise(F.col("value")).alias("value"))


@query("scan_sheets", "select n_name label, n_nationkey * 1.5e0 x, n_regionkey * 1e0 y, 3e0 z from nation where n_nationkey % 5 <> 0")
def scan_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Worksheets whose columns go by several names; rows whose coordinates are no numbers go."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = table(spark, d, "nation").orderBy("n_nationkey").select("n_name", "n_nationkey", "n_regionkey").collect()  # 25 rows
    cells = [["Z", "Name ", "easting", "Y"]] + [[3, r[0], r[1] * 1.5 if r[1] % 5 else "n/a", r[2]] for r in rows]
    one = lambda v, at: f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v}</v></c>'
    sheet = "".join("<row>" + "".join(one(v, f"{'ABCD'[i]}{n}") for i, v in enumerate(row)) + "</row>" for n, row in enumerate(cells, 1))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="marks"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    root = scratch_dir(spark, "sheets")
    put(spark, f"{root}/a.xlsx", buf.getvalue())
    return files.read_spreadsheets(spark, root, {"label": ["label", "name"], "x": ["x", "easting"], "y": ["y"], "z": ["z"]}, "marks").drop("path")


@query("scan_images", "select s_suppkey pose_id, 4::bigint width, 3::bigint height, (s_suppkey % 12) / 12e0 rgb_black, (s_suppkey % 5) / 12e0 depth_black, greatest(s_suppkey % 12, s_suppkey % 5) <= 3 valid from supplier")
def scan_images(spark: SparkSession, d: str) -> DataFrame:
    """Colour and depth images of a pose, and which are valid by their shares of black pixels."""
    from skytrail.operators.metadata import frame_validity

    root = scratch_dir(spark, "images")
    s = spread(table(spark, d, "supplier").select("s_suppkey"))
    samples = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(i < F.col("s_suppkey") % 12, F.array(*[F.lit(0)] * 3)).otherwise(F.array(F.lit(0), F.lit(9), F.lit(200)))))
    metres = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(i < F.col("s_suppkey") % 5, F.lit(float("nan"))).otherwise(i * 100.0 + 0.5))
    name = F.concat(F.lit("pose_"), F.col("s_suppkey").cast("string"), F.lit(".png"))
    media.write_files(s.select(F.concat(F.lit("rgb/"), name).alias("path"), media.rgb_png(samples, F.lit(4)).alias("content")), root)
    media.write_files(s.select(F.concat(F.lit("depth/"), name).alias("path"), media.depth_png(metres, F.lit(4)).alias("content")), root)
    rgb, depth = (files.read_images(spark, f"{root}/{k}") for k in ("rgb", "depth"))
    both = rgb.select("pose_id", "size.width", "size.height", media.black_ratio("content").alias("rgb_black")).join(depth.select("pose_id", media.black_ratio("content").alias("depth_black")), "pose_id")
    return frame_validity(both, 0.25)


@query("scan_folders", "select 'largest' what, '10' as name union all select 'present', 'env_2' union all select 'present', 'env_0' union all select 'new', '11'")
def scan_folders(spark: SparkSession, d: str) -> DataFrame:
    """The folder of the largest number, the requested scenes that are there, and the folder that came last."""
    root = scratch_dir(spark, "folders")
    for n in ("9", "10", "x"):
        put(spark, f"{root}/steps/{n}/a.txt", b"a")
    for env, n in (("env_0", "instruction.txt"), ("env_1", "other.txt"), ("env_2", "instruction.txt")):
        put(spark, f"{root}/scenes/{env}/{n}", b"a")
    largest = files.largest_numbered(spark, f"{root}/steps")
    before = files.snapshot(spark, f"{root}/steps")
    put(spark, f"{root}/steps/11/a.txt", b"a")
    rows = [("largest", largest.rsplit("/", 1)[1])]
    rows += [("present", e) for e in files.environments(spark, f"{root}/scenes", requested=["env_2", "env_1", "env_0", "env_7"])]
    rows += [("new", files.appeared(spark, f"{root}/steps", before).rsplit("/", 1)[1])]
    return spark.createDataFrame(rows, "what string, name string")


@query("present_scenes", with_views(TRACK, EPISODES) + "select env_id, count(*) n from v_episode where env_id in ('env_0', 'env_2') group by 1")
def present_scenes(spark: SparkSession, d: str) -> DataFrame:
    return files.only_present(v_episode(spark, d), ["env_2", "env_0"]).groupBy("env_id").agg(F.count("*").alias("n"))


@query("file_manifest", "select 'd' || s_suppkey || '/note.txt' file, strlen(s_name || 'ü') size_bytes, sha256(s_name || 'ü') sha256 from supplier where s_suppkey % 2 = 0")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Files that were mirrored to another folder, without those of a format that is left out."""
    a, b = scratch_dir(spark, "assets"), scratch_dir(spark, "mirror")
    s = spread(table(spark, d, "supplier")).select(F.concat(F.lit("d"), F.col("s_suppkey").cast("string"), F.when(F.expr("s_suppkey % 2 = 0"), "/note.txt").otherwise("/a.parquet")).alias("path"), F.concat("s_name", F.lit("ü")).cast("binary").alias("content"))
    media.write_files(s, a)
    media.mirror(spark, a, b)
    return files.manifest(spark, b).select(F.regexp_extract("path", r"(d\d+/[^/]+)$", 1).alias("file"), "size_bytes", "sha256")


@query("refused_overwrite", "select 'dataset' what, true refused union all select 'text', true")
def refused_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """What is there is not written over, unless that is asked for."""
    root = scratch_dir(spark, "refuse")
    f = spark.range(3).select(F.lit(0).cast("long").alias("episode_index"), F.col("id").alias("frame_index"))
    line = spark.createDataFrame([("a",)], "value string")
    rows = []
    for what, write in (("dataset", lambda **k: sinks.write_episodes(f, root, **k)), ("text", lambda **k: sinks.write_lines(spark, f"{root}/a.txt", line, **k))):
        write(overwrite=True)
        try:
            write(overwrite=False)
            rows.append((what, False))
        except FileExistsError:
            write(overwrite=True)
            rows.append((what, True))
    return spark.createDataFrame(rows, "what string, refused boolean")
