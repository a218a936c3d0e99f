"""Readers of pose, instruction, stage, metadata, landmark and outline text files.

Lines are numbered within their file by their byte order, so that "last one wins" and "file order"
are columns.  Blank lines and lines that start with # are skipped.  strict readers raise on a line
with too few fields, others leave it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skytrail.functions import angles
from skytrail.sources.scratch import small

SPACE = r"(?U)\s+"
BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))  # what SPACE takes


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line): every line, numbered from 0 within its file.

    Files are read in splits.  A line's number is its place in its split and the lines of those before,
    which a scan in the same plan counts, as splits may differ from one plan to the next.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("line"))
    splits = raw.groupBy("file", "_at").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "_at", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_add"))
    both = raw.join(small(splits, len(raw._jdf.inputFiles())), ["file", "_at"], "left")
    number = F.when(F.col("_add").isNull(), F.raise_error(F.lit("the splits of a file changed while it was read")).cast("long")).otherwise(F.col("_i") + F.col("_add"))
    return both.select("file", number.alias("line_no"), "line")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line): trimmed, without blank lines and comments."""
    return numbered(spark, path).withColumn("line", F.btrim("line", F.lit(BLANKS))).filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of the comment lines."""
    return numbered(spark, path).withColumn("line", F.regexp_replace("line", "\r$", "")).filter(F.trim("line").startswith("#"))


def fields(df: DataFrame, n: int, strict: bool, rest: bool = True) -> DataFrame:
    """Adds f, the first n fields of the line; with rest, the last one is the rest of the line."""
    out = df.withColumn("f", F.split("line", SPACE, n if rest else -1))
    if not strict:
        return out.filter(F.size("f") >= n)
    bad = F.raise_error(F.concat(F.lit("bad line in "), F.col("file"), F.lit(": "), F.col("line"))).cast("array<string>")
    return out.withColumn("f", F.when(F.size("f") < n, bad).otherwise(F.col("f")))


def env_of(file: Column) -> Column:
    """The folder that a scene's file lies in."""
    return F.substring_index(F.substring_index(file, "/", -2), "/", 1)


def _f(i: int, kind: str) -> Column:
    return F.col("f")[i].cast(kind)


def read_poses(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """env_id, pose_id, x, y, z, omega, phi, kappa (degrees), line_no; of equal ids the last line counts."""
    p = fields(lines(spark, path), 7, strict, rest=False).select(env_of(F.col("file")).alias("env_id"), _f(0, "long").alias("pose_id"), *[_f(i, "double").alias(c) for i, c in enumerate(("x", "y", "z", "omega", "phi", "kappa"), 1)], "line_no")
    # Numbers one by one, which are aggregated by hashes; a struct would be sorted.
    last = [F.max_by(c, "line_no").alias(c) for c in ("x", "y", "z", "omega", "phi", "kappa")]
    return p.groupBy("env_id", "pose_id").agg(*last, F.max("line_no").alias("line_no"))


def states(poses: DataFrame, task: str) -> DataFrame:
    """The recorded state of each pose: float32 x, y, z and one angle in radians."""
    return poses.select("env_id", "pose_id", *[F.col(c).cast("float").alias(c) for c in "xyz"], angles.pose_angle(F.lit(task), "phi", "kappa").cast("float").alias("a"))


def read_instructions(spark: SparkSession, path: str, with_env: bool = True) -> DataFrame:
    """Episodes of a split file (env_id first) or of a scene's own file (its folder is the env_id)."""
    k = int(with_env)
    t = fields(lines(spark, path), 4 + k, strict=True)
    env = _f(0, "string") if with_env else env_of(F.col("file"))
    t = t.select(env.alias("env_id"), *[_f(i + k, "long").alias(c) for i, c in enumerate(("traj_id", "pose_start", "pose_end"))], _f(3 + k, "string").alias("instruction"), F.col("line_no").alias("pos"))
    return t.withColumn("length", F.expr("pose_end - pose_start + 1"))


def read_stages(spark: SparkSession, path: str) -> DataFrame:
    t = fields(lines(spark, path), 5, strict=True)
    return t.select(env_of(F.col("file")).alias("env_id"), *[_f(i, kind).alias(c) for i, (c, kind) in enumerate((("traj_id", "long"), ("subtask_id", "int"), ("pose_start", "long"), ("pose_end", "long"), ("text", "string")))])


def grouped_stages(stages: DataFrame, by_id: bool = False) -> DataFrame:
    """One row a trajectory with its stages in order: by (start, end, id), or with by_id by (id, start, end)."""
    order = ["subtask_id", "pose_start", "pose_end"] if by_id else ["pose_start", "pose_end", "subtask_id"]
    return stages.groupBy("env_id", "traj_id").agg(F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("stages"))


def read_trajectory_meta(spark: SparkSession, path: str) -> DataFrame:
    """traj_id, name, pose_start, pose_end: the id is the first field, the range the last two, and what
    lies between (one or two names, with spaces or tabs) is the name."""
    m = r"^(\d+)\s+(?:(.*?)\s+)?(\d+)\s+(\d+)$"
    t = lines(spark, path).filter(F.col("line").rlike(m))
    g = lambda i: F.regexp_extract("line", m, i)
    name = F.trim(F.split(g(2), "\t")[0])
    return t.select(env_of(F.col("file")).alias("env_id"), g(1).cast("long").alias("traj_id"), name.alias("name"), g(3).cast("long").alias("pose_start"), g(4).cast("long").alias("pose_end"))


def read_valid_ids(spark: SparkSession, path: str) -> DataFrame:
    return fields(lines(spark, path), 1, strict=True, rest=False).select(env_of(F.col("file")).alias("env_id"), _f(0, "long").alias("traj_id")).distinct()


def only_valid(episodes: DataFrame, valid: DataFrame | None) -> DataFrame:
    """A scene without a list of valid ids (no file) keeps all its episodes; None: no scene has one."""
    if valid is None:
        return episodes
    listed = valid.select("env_id").distinct().withColumn("_listed", F.lit(True))
    hits = valid.withColumn("_ok", F.lit(True))
    both = episodes.join(listed, "env_id", "left").join(hits, ["env_id", "traj_id"], "left")
    return both.filter("_listed is null or _ok").drop("_listed", "_ok")


def _label(from_field: int) -> Column:
    rest = F.array_join(F.slice("f", from_field + 1, 1_000_000), " ")
    return F.regexp_replace(rest, "^[ ,，。；;]+|[ ,，。；;]+$", "")


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """env_id, x, y, label: lines whose first two fields are numbers."""
    t = lines(spark, path).withColumn("f", F.split("line", SPACE))
    x, y = (F.col("f")[i].try_cast("float") for i in (0, 1))
    t = t.filter(F.size("f") >= 4).withColumns({"x": x, "y": y}).filter("x is not null and y is not null")
    return t.select(env_of(F.col("file")).alias("env_id"), "x", "y", _label(3).alias("label"), "line_no")


def read_polylines(spark: SparkSession, path: str, kind: str, eps: float = 1e-6) -> DataFrame:
    """One object a file: name, its points without repeats of the last kept one, and the median z.

    Outlines of buildings and fields need three points; roads need two, and lose a last point that
    closes them.
    """
    from skytrail.operators.geometry import drop_repeats

    t = lines(spark, path).withColumn("f", F.split("line", SPACE)).filter(F.size("f") >= 3)
    t = t.select("file", "line_no", *[F.col("f")[i].try_cast("double").alias(c) for i, c in enumerate("xyz")]).filter("x is not null and y is not null and z is not null")
    p = t.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", "x", "y", "z"))).alias("p"), F.percentile("z", 0.5).alias("target_z"))
    p = p.withColumn("p", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z"))))
    p = p.withColumn("pts", drop_repeats(F.col("p"), eps))
    if kind == "road":
        a, b = F.get("pts", F.lit(0)), F.get("pts", F.size("pts") - 1)
        closed = (F.size("pts") > 2) & (F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)) <= eps)
        p = p.withColumn("pts", F.when(closed, F.slice("pts", 1, F.size("pts") - 1)).otherwise(F.col("pts")))
    name = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return p.filter(F.size("pts") >= (2 if kind == "road" else 3)).select(name.alias("name"), F.lit(kind).alias("kind"), "pts", "target_z")


def intrinsics_of_header(spark: SparkSession, path: str) -> DataFrame:
    """width, height, fx, fy, cx, cy and fields of view from the comment after "intrinsics:"."""
    h = headers(spark, path).withColumn("_before", F.lag("line").over(Window.partitionBy("file").orderBy("line_no")))
    h = h.filter(F.lower("_before").contains("intrinsics")).withColumn("f", F.split(F.regexp_replace("line", r"^\s*#\s*", ""), r"[\s,]+"))
    h = h.filter(F.size("f") >= 6).select("file", *[F.col("f")[i].cast("double").alias(c) for i, c in enumerate(("width", "height", "fx", "fy", "cx", "cy"))])
    return h.withColumns({"fov_x": 2.0 * F.atan(0.5 * F.col("width") / F.col("fx")), "fov_y": 2.0 * F.atan(0.5 * F.col("height") / F.col("fy"))})


def read_model_metadata(spark: SparkSession, path: str) -> DataFrame:
    """SRS text and origin of metadata.xml; an ENU origin is its latitude and longitude."""
    x = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim(F.expr("xpath_string(value, '/ModelMetadata/SRS')")).alias("srs"), F.split(F.expr("xpath_string(value, '/ModelMetadata/SRSOrigin')"), ",").alias("o"))
    enu = F.regexp_extract("srs", r"^ENU:\s*([-+.\d]+)\s*,\s*([-+.\d]+)", 1), F.regexp_extract("srs", r"^ENU:\s*([-+.\d]+)\s*,\s*([-+.\d]+)", 2)
    return x.select("file", "srs", *[F.trim(F.get("o", F.lit(i))).try_cast("double").alias(c) for i, c in enumerate(("x", "y", "z"))], *[v.try_cast("double").alias(n) for v, n in zip(enu, ("lat", "lon"), strict=True)], F.regexp_extract("srs", r"^EPSG:(\d+)", 1).try_cast("int").alias("epsg"))


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """(photo, image, x, y, z) of every photo of a camera-block XML."""
    p = spark.read.format("xml").option("rowTag", "Photo").schema("Id long, ImagePath string, Pose struct<Center: struct<x: double, y: double, z: double>>").load(path)
    return p.select(F.col("Id").alias("photo"), F.col("ImagePath").alias("image"), *[F.col(f"Pose.Center.{c}").alias(c) for c in "xyz"])


def read_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    """Intrinsics of the first photo group of a camera-block XML; a missing aspect ratio is 1."""
    base = "/BlocksExchange/Block/Photogroups/Photogroup[1]"
    v = lambda tag: F.expr(f"xpath_string(value, '({base}/{tag}|/Block/Photogroups/Photogroup[1]/{tag})[1]')").try_cast("double")
    x = spark.read.text(path, wholetext=True)
    x = x.select(v("ImageDimensions/Width").cast("int").alias("width"), v("ImageDimensions/Height").cast("int").alias("height"), v("FocalLengthPixels").alias("fx"), F.coalesce(v("AspectRatio"), F.lit(1.0)).alias("_r"), v("PrincipalPoint/x").alias("cx"), v("PrincipalPoint/y").alias("cy"))
    return x.withColumn("fy", F.col("fx") * F.col("_r")).drop("_r")
