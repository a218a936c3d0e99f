"""Sampling and smoothing of paths.  Sampling is an explode of a sequence; what depends on the last
kept or last smoothed element is a fold over an array."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrail.functions import angles


def line_points(df: DataFrame, p0: list[str], p1: list[str], step: float, skip_first: bool = True, keep: list[str] = ()) -> DataFrame:
    """Points from p0 to p1 every `step`, and p1 itself if the last is over 1e-4 away from it.

    A line without length is its end alone.  Adds i (from 0), x, y, z; `keep` are carried along.
    """
    length = angles.distance([F.col(c) for c in p1], [F.col(c) for c in p0])
    df = df.withColumn("_len", length).withColumn("_n", F.floor(F.col("_len") / step).cast("int"))
    at = F.transform(F.filter(F.sequence(F.lit(0), F.col("_n")), lambda i: i >= int(skip_first)), lambda i: i * F.lit(float(step)))
    last = F.coalesce(F.get(at, F.size(at) - 1), F.lit(-1.0))
    at = F.when(F.col("_len") < 1e-6, F.array(F.col("_len"))).when((F.size(at) == 0) | (F.col("_len") - last > 1e-4), F.array_append(at, F.col("_len"))).otherwise(at)
    df = df.select(*keep, *p0, *p1, "_len", F.posexplode(at).alias("i", "_s"))
    share = F.when(F.col("_len") < 1e-6, F.lit(1.0 if skip_first else 0.0)).otherwise(F.col("_s") / F.col("_len"))
    return df.select(*keep, "i", *[(F.col(a) + (F.col(b) - F.col(a)) * share).alias(c) for a, b, c in zip(p0, p1, "xyz", strict=True)])


def turn_angles(start: Column, end: Column, step_deg: float) -> Column:
    """Headings from start to end the short way, as an array: start left out, end included; none for
    a turn of under a thousandth of a degree.  A turn of whole steps has them all, whatever rounding did."""
    d = angles.wrap_rad(end - start)
    n = F.greatest(F.lit(1), F.floor(F.degrees(F.abs(d)) / step_deg + 1e-9).cast("int"))
    return F.when(F.degrees(F.abs(d)) < 1e-3, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: start + d * (i / n)))


def spiral_points(a0: Column, r0: Column, r1: Column, z0: Column, z1: Column, turns: float, step: float, cx: Column, cy: Column, ccw: bool) -> Column:
    """Array of (x, y, z) along turns of a circle whose radius and height change evenly; the start is
    left out.  A circle has equal radii and heights."""
    length = 2 * math.pi * turns * (r0 + r1) / 2.0
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(length * length + (z1 - z0) * (z1 - z0)) / max(step, 1e-6)).cast("int"))
    sign = 1.0 if ccw else -1.0

    def point(i: Column) -> Column:
        t = i / n
        a, r = a0 + sign * 2 * math.pi * turns * t, r0 + (r1 - r0) * t
        return F.struct((cx + r * F.cos(a)).alias("x"), (cy + r * F.sin(a)).alias("y"), (z0 + (z1 - z0) * t).alias("z"))

    return F.transform(F.sequence(F.lit(1), n), point)


def drop_repeats(points: Column, eps: float = 1e-6) -> Column:
    """Without points (x, y, ...) that lie within eps of the last one kept."""

    def step(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        near = F.sqrt(F.pow(p["x"] - last["x"], 2) + F.pow(p["y"] - last["y"], 2)) <= eps
        return F.when(F.coalesce(near, F.lit(False)), acc).otherwise(F.array_append(acc, p))

    return F.aggregate(points, F.filter(points, lambda p: F.lit(False)), step)


def smooth_ring(df: DataFrame, key: list[str], order: str, cols: list[str], window: int, iterations: int = 1) -> DataFrame:
    """Moving averages around closed rings; an even window reaches one further back than ahead.
    Rings of fewer than three points stay as they are."""
    half = window // 2
    for _ in range(iterations if window > 1 else 0):
        n = F.count("*").over(Window.partitionBy(*key))
        rows = df.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1).withColumn("_n", n)
        # The ring is laid out with `half` points repeated before and after it.
        laps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
        padded = rows.withColumn("_lap", F.explode(laps)).withColumn("_j", F.col("_i") + F.col("_lap") * F.col("_n")).filter((F.col("_j") >= -half) & (F.col("_j") < F.col("_n") + half))
        w = Window.partitionBy(*key).orderBy("_j").rowsBetween(-half, window - 1 - half)
        means = {c: F.when(F.col("_n") < 3, F.col(c)).otherwise(F.avg(c).over(w)) for c in cols}
        df = padded.withColumns(means).filter("_lap = 0").select(*df.columns)
    return df


def smooth_open(df: DataFrame, key: list[str], order: str, cols: list[str], window: int, iterations: int = 1) -> DataFrame:
    """Moving averages along open paths whose ends are repeated; an even window is made odd."""
    half = window // 2
    for _ in range(iterations if window > 1 else 0):
        w = Window.partitionBy(*key).orderBy(order)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
        ahead = F.greatest(F.lit(0), F.col("_i") + half - F.col("_n"))
        behind = F.greatest(F.lit(0), half + 1 - F.col("_i"))
        around = w.rowsBetween(-half, half)
        means = {c: F.when(F.col("_n") < 3, F.col(c)).otherwise((F.sum(c).over(around) + behind * F.first(c).over(whole) + ahead * F.last(c).over(whole)) / (2 * half + 1)) for c in cols}
        df = rows.withColumns(means).select(*df.columns)
    return df


def tangents(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Adds tx, ty: unit steps to the next point (at the last one, from the one before); a point that
    repeats its neighbour takes over the direction before it."""
    w = Window.partitionBy(*key).orderBy(order)
    step = {c: F.coalesce(F.lead(c).over(w) - F.col(c), F.col(c) - F.lag(c).over(w)) for c in "xy"}
    df = df.withColumns({f"_d{c}": v for c, v in step.items()}).withColumn("_n", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    unit = {f"t{c}": F.coalesce(F.last(F.when(F.col("_n") >= 1e-6, F.col(f"_d{c}") / (F.col("_n") + 1e-8)), ignorenulls=True).over(so_far), F.lit(first)) for c, first in (("x", 1.0), ("y", 0.0))}
    return df.withColumns(unit).drop("_dx", "_dy", "_n")


def smooth_headings(headings: Column, alpha: float = 0.75) -> Column:
    """Exponential smoothing of an array of unit vectors (x, y), each made a unit again before the next."""

    def step(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        x, y = alpha * last["x"] + (1 - alpha) * p["x"], alpha * last["y"] + (1 - alpha) * p["y"]
        n = F.sqrt(x * x + y * y) + 1e-12
        return F.array_append(acc, F.when(last.isNull(), p).otherwise(F.struct((x / n).alias("x"), (y / n).alias("y"))))

    return F.aggregate(headings, F.filter(headings, lambda p: F.lit(False)), step)


def arc_lengths(df: DataFrame, key: list[str], order: str, cols: list[str] = ("x", "y")) -> DataFrame:
    """Adds s, the length of the path up to each point, and _next columns of the segment after it."""
    w = Window.partitionBy(*key).orderBy(order)
    step = F.coalesce(angles.distance([F.col(c) for c in cols], [F.lag(c).over(w) for c in cols]), F.lit(0.0))
    df = df.withColumn("_d", step).withColumn("s", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in cols}).withColumn("next_s", F.lead("s").over(w))


def resample(df: DataFrame, key: list[str], order: str, step: float, cols: list[str] = ("x", "y")) -> DataFrame:
    """Points every `step` along each path, and its end: (key, i, s, cols).

    Each segment makes the samples that fall on it, so nothing is joined: those with s in [s, next_s),
    the last one also its end.
    """
    arcs = arc_lengths(df, key, order, cols).withColumn("_total", F.max("s").over(Window.partitionBy(*key)))
    seg = arcs.filter("next_s > s")
    lo, hi = F.ceil(F.col("s") / step - 1e-12), F.ceil(F.col("next_s") / step - 1e-12) - 1
    at = F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda i: i * F.lit(float(step)))).otherwise(F.array().cast("array<double>"))
    at = F.when(F.col("next_s") == F.col("_total"), F.array_append(at, F.col("_total"))).otherwise(at)
    pts = seg.withColumn("_t", F.explode(at))
    share = (F.col("_t") - F.col("s")) / (F.col("next_s") - F.col("s"))
    out = pts.select(*key, F.col("_t").alias("s"), *[(F.col(c) + (F.col(f"next_{c}") - F.col(c)) * share).alias(c) for c in cols])
    return out.withColumn("i", (F.row_number().over(Window.partitionBy(*key).orderBy("s")) - 1).cast("long"))


def cut_corners(points: Column, iterations: int = 8) -> Column:
    """Chaikin's corner cutting of an array of (x, y, z): ends stay."""
    out = points
    for _ in range(iterations):
        out = _cut(out)
    return out


def _cut(p: Column) -> Column:
    def mixed(a: Column, b: Column, t: float) -> Column:
        return F.struct(*[((1 - t) * a[c] + t * b[c]).alias(c) for c in "xyz"])

    n = F.size(p)
    inner = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.array(mixed(F.get(p, i), F.get(p, i + 1), 0.25), mixed(F.get(p, i), F.get(p, i + 1), 0.75))))
    return F.when(n < 3, p).otherwise(F.concat(F.slice(p, 1, 1), inner, F.slice(p, n, 1)))


def bounds(df: DataFrame, key: list[str], cols: list[str] = ("x", "y", "z")) -> DataFrame:
    return df.groupBy(*key).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))])


def box_overlap(a: DataFrame, b: DataFrame, on: list[str], cols: list[str] = ("x", "y", "z")) -> DataFrame:
    """Overlap of two tables of bounds: extents, whether they meet, and the share of the smaller box."""
    both = a.join(b.select(*on, *[F.col(f"{n}_{c}").alias(f"b_{n}_{c}") for c in cols for n in ("min", "max")]), on)
    size = {c: F.least(f"max_{c}", f"b_max_{c}") - F.greatest(f"min_{c}", f"b_min_{c}") for c in cols}
    both = both.withColumns({f"overlap_{c}": F.greatest(v, F.lit(0.0)) for c, v in size.items()})
    volume = lambda lo, hi: math.prod([F.col(f"{hi}_{c}") - F.col(f"{lo}_{c}") for c in cols], start=F.lit(1.0))
    inter = math.prod([F.col(f"overlap_{c}") for c in cols], start=F.lit(1.0))
    smaller = F.least(volume("min", "max"), volume("b_min", "b_max"))
    return both.select(*on, *[f"overlap_{c}" for c in cols], (inter > 0).alias("meets"), F.when(smaller > 0, inter / smaller).otherwise(0.0).alias("share"))


def strip_crop(triangles: DataFrame, start: list[float], goal: list[float], half_width: float, half_height: float, pad: float, margin: float) -> DataFrame:
    """Triangles (a*, b*, c*) whose extents meet the strip from start to goal, turned into its frame;
    if start and goal lie over one another, their box."""
    dx, dy = goal[0] - start[0], goal[1] - start[1]
    n = math.hypot(dx, dy)
    z_lo, z_hi = min(start[2], goal[2]) - half_height - margin, max(start[2], goal[2]) + half_height + margin

    def meets(values: list[Column], lo: float, hi: float) -> Column:
        return (F.greatest(*values) >= lo) & (F.least(*values) <= hi)

    xy = [(F.col(f"{v}x") - start[0], F.col(f"{v}y") - start[1]) for v in "abc"]
    if n > 1e-6:
        u = (dx / n, dy / n)
        along, across = [x * u[0] + y * u[1] for x, y in xy], [y * u[0] - x * u[1] for x, y in xy]
        keep = meets(along, -pad - margin, n + pad + margin) & meets(across, -half_width - margin, half_width + margin)
    else:
        r = pad + half_width + margin
        keep = meets([x for x, _ in xy], min(0, dx) - r, max(0, dx) + r) & meets([y for _, y in xy], min(0, dy) - r, max(0, dy) + r)
    return triangles.filter(keep & meets([F.col(f"{v}z") for v in "abc"], z_lo, z_hi))


def concat_blocks(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of vertices (block, i, ...) and faces (block, i, idx) as one mesh: vertices numbered
    block after block, face indexes moved along.  Blocks are few, so their offsets are a window."""
    sizes = vertices.groupBy("block").agg(F.count("*").alias("_n"))
    offsets = sizes.select("block", F.coalesce(F.sum("_n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    v = vertices.join(offsets, "block").withColumn("vertex", F.col("i") + F.col("_off")).drop("_off")
    f = faces.join(offsets, "block").withColumn("idx", F.transform("idx", lambda k: k + F.col("_off"))).drop("_off")
    return v, f


def clean_mesh(faces: DataFrame) -> DataFrame:
    """Faces (face, idx of three) without those that repeat a vertex, and without repeats of another
    face, whichever way around; of equal ones the first stays.  Then faces on edges that more than
    two faces share are left out."""
    f = faces.withColumn("_set", F.array_sort(F.array_distinct("idx"))).filter(F.size("_set") == 3)
    f = f.groupBy("_set").agg(F.min(F.struct("face", "idx")).alias("_f")).select("_f.face", "_f.idx", "_set")
    edges = f.select("face", F.explode(F.array(*[F.struct(F.col("_set")[a].alias("u"), F.col("_set")[b].alias("v")) for a, b in ((0, 1), (0, 2), (1, 2))])).alias("e"))
    crowded = edges.groupBy("e").agg(F.count("*").alias("n")).filter("n > 2").select("e")
    return f.join(edges.join(crowded, "e").select("face").distinct(), "face", "left_anti").select("face", "idx")
