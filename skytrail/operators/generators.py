"""Trajectory generators: tables of poses from landmarks and outlines.

Every trajectory draws its uniforms from a hash of (seed, object, k, draw), so rows can be made in any
order on any executor.  Poses have a global, gapless pose_id; stages have inclusive pose ranges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrail.functions import angles
from skytrail.operators import geometry
from skytrail.operators.outlines import grow_ring
from skytrail.sources.scratch import small, written

POINT = "array<struct<stage:int,x:double,y:double,z:double,yaw:double>>"


def uniform(seed: int, draw: str, *keys: str) -> Column:
    """In [0, 1): the first 52 bits of a digest of (seed, draw, keys), which SQL can make too."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(draw), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _trajectories(objects: DataFrame, per: int) -> DataFrame:
    return objects.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))


def _turn(stage: int, start: str, end: str, at: list[str], step_deg: float) -> Column:
    """Points that stay in place and turn."""
    return F.transform(geometry.turn_angles(F.col(start), F.col(end), step_deg), lambda a: _point(stage, *[F.col(c) for c in at], a))


def _point(stage: int, x: Column, y: Column, z: Column, yaw: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), x.alias("x"), y.alias("y"), z.alias("z"), yaw.alias("yaw"))


def _fly(stage: int, p0: list[str], p1: list[str], yaw: str, step: float) -> Column:
    """Points along a line, its start left out and its end included."""
    a, b = [F.col(c) for c in p0], [F.col(c) for c in p1]
    length = angles.distance(b, a)
    n = F.floor(length / step).cast("int")
    at = F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: i * F.lit(float(step)))).otherwise(F.array().cast("array<double>"))
    last = F.coalesce(F.get(at, F.size(at) - 1), F.lit(0.0))
    at = F.when((F.size(at) == 0) | (length - last > 1e-4), F.array_append(at, length)).otherwise(at)
    share = lambda s: F.when(length < 1e-6, 1.0).otherwise(s / length)
    return F.transform(at, lambda s: _point(stage, *[x + (y - x) * share(s) for x, y in zip(a, b, strict=True)], F.col(yaw)))


def numbered(paths: DataFrame, order: list[str]) -> DataFrame:
    """paths: a row a trajectory with its `points`; order tells the rows apart.  Adds n_poses, traj_id and
    pose_start, the poses of all trajectories before it; those without points go.

    The window without a partition runs over (order, n_poses) alone; points are written once, and
    joined to their numbers, so that no task holds the poses of all trajectories.
    """
    sized = written(paths, "paths").withColumn("n_poses", F.size("points").cast("long")).filter("n_poses > 0")
    w = Window.orderBy(*order)
    before = F.coalesce(F.sum("n_poses").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    numbers = sized.select(*order, (F.row_number().over(w) - 1).cast("long").alias("traj_id"), before.alias("pose_start"))
    return sized.join(small(numbers, sized.count()), order)


def poses(paths: DataFrame) -> DataFrame:
    p = paths.select("traj_id", "pose_start", F.posexplode("points").alias("i", "p"))
    return p.select("traj_id", (F.col("pose_start") + F.col("i")).alias("pose_id"), "p.stage", "p.x", "p.y", "p.z", "p.yaw")


def stage_ranges(paths: DataFrame, stages: int, placeholders: bool = False) -> DataFrame:
    """(traj_id, subtask_id, pose_start, pose_end, is_placeholder).  A stage without poses has none,
    or with placeholders one pose that it shares with a neighbour."""
    p = paths.select("traj_id", "pose_start", "n_poses", "points", F.explode(F.sequence(F.lit(0), F.lit(stages - 1))).alias("subtask_id"))
    before = F.size(F.filter("points", lambda q: q["stage"] < F.col("subtask_id")))
    here = F.size(F.filter("points", lambda q: q["stage"] == F.col("subtask_id")))
    p = p.withColumn("_n", here).withColumn("_from", F.col("pose_start") + F.least(before.cast("long"), F.col("n_poses") - F.when(here == 0, 1).otherwise(0)))
    p = p.select("traj_id", "subtask_id", F.col("_from").alias("pose_start"), (F.col("_from") + F.greatest(F.col("_n"), F.lit(1)) - 1).alias("pose_end"), (F.col("_n") == 0).alias("is_placeholder"))
    return p if placeholders else p.filter("not is_placeholder")


def landing(landmarks: DataFrame, per: int = 15, seed: int = 42, radius: float = 60.0, heights: tuple[float, float] = (80.0, 100.0), ends: tuple[float, ...] = (-20.0, -10.0, 0.0), step: float = 1.0, yaw_step: float = 5.0) -> DataFrame:
    """landmarks: (name, x, y).  Stages: turn to the landmark, fly above it, descend."""
    keys = ("name", "k")
    t = _trajectories(landmarks, per)
    u = {d: uniform(seed, d, *keys) for d in ("r", "theta", "z", "yaw", "end")}
    t = t.withColumns({"_r": radius * F.sqrt(u["r"]), "_theta": 2 * math.pi * u["theta"], "z0": heights[0] + (heights[1] - heights[0]) * u["z"], "yaw0": 2 * math.pi * u["yaw"]})
    t = t.withColumns({"x0": F.col("x") + F.col("_r") * F.cos("_theta"), "y0": F.col("y") + F.col("_r") * F.sin("_theta"), "z1": F.get(F.array(*[F.lit(e) for e in ends]), F.floor(u["end"] * len(ends)).cast("int"))})
    t = t.withColumn("yaw1", F.when(F.col("_r") < 1e-6, F.col("yaw0")).otherwise(F.atan2(F.col("y") - F.col("y0"), F.col("x") - F.col("x0"))))
    points = F.concat(_turn(0, "yaw0", "yaw1", ["x0", "y0", "z0"], yaw_step), _fly(1, ["x0", "y0", "z0"], ["x", "y", "z0"], "yaw1", step), _fly(2, ["x", "y", "z0"], ["x", "y", "z1"], "yaw1", step))
    return numbered(t.withColumn("points", points).select("name", "k", F.col("z1").alias("end_height"), "points"), ["name", "k"])


def orbit(landmarks: DataFrame, per: int = 9, seed: int = 42, radius: float = 20.0, end_radius: float | None = None, turns: float = 1.0, start_radius: float = 60.0, heights: tuple[float, float] = (80.0, 100.0), end_height: float = -20.0, last_height: float | None = None, radii: tuple[float, ...] = (), step: float = 1.0, yaw_step: float = 5.0, ccw: bool = False) -> DataFrame:
    """landmarks: (name, x, y).  Stages: turn, slanted descent to the circle, turn along it, orbit,
    turn back, slanted return.

    radii: the radius is drawn from them.  end_radius, turns and last_height make a spiral.  Starts lie
    at least a metre outside the circle: the annulus is drawn by area, so no draw is thrown away.
    """
    keys = ("name", "k")
    t = _trajectories(landmarks, per)
    r = F.get(F.array(*[F.lit(v) for v in radii]), F.floor(uniform(seed, "radius", *keys) * len(radii)).cast("int")) if radii else F.lit(radius)
    t = t.withColumn("radius", r)
    inner = F.col("radius") + 1.0
    far = F.greatest(F.lit(start_radius), inner + 1.0)
    t = t.withColumns({"_r": F.sqrt(inner * inner + uniform(seed, "r", *keys) * (far * far - inner * inner)), "_theta": 2 * math.pi * uniform(seed, "theta", *keys), "z0": heights[0] + (heights[1] - heights[0]) * uniform(seed, "z", *keys), "yaw0": 2 * math.pi * uniform(seed, "yaw", *keys)})
    sign = 1.0 if ccw else -1.0
    t = t.withColumns({"x0": F.col("x") + F.col("_r") * F.cos("_theta"), "y0": F.col("y") + F.col("_r") * F.sin("_theta")})
    # The entry lies on the line to the centre, so it is at the angle of the start.
    t = t.withColumns({"yaw1": angles.wrap_rad(F.col("_theta") + math.pi), "x1": F.col("x") + F.col("radius") * F.cos("_theta"), "y1": F.col("y") + F.col("radius") * F.sin("_theta"), "z1": F.lit(end_height), "yaw2": angles.wrap_rad(F.col("_theta") + sign * math.pi / 2)})
    r1 = F.lit(end_radius) if end_radius is not None else F.col("radius")
    z1 = F.lit(last_height if last_height is not None else end_height)
    ring = geometry.spiral_points(F.col("_theta"), F.col("radius"), r1, F.col("z1"), z1, turns, step, F.col("x"), F.col("y"), ccw)
    t = t.withColumn("_ring", ring)
    a = lambda p: F.atan2(p["y"] - F.col("y"), p["x"] - F.col("x")) + sign * math.pi / 2
    orbit_points = F.transform("_ring", lambda p: _point(3, p["x"], p["y"], p["z"], angles.wrap_rad(a(p))))
    end = F.get("_ring", F.size("_ring") - 1)
    t = t.withColumns({"x2": end["x"], "y2": end["y"], "z2": end["z"]})
    t = t.withColumns({"yaw3": angles.wrap_rad(F.atan2(F.col("y2") - F.col("y"), F.col("x2") - F.col("x")) + sign * math.pi / 2), "yaw4": F.atan2(F.col("y0") - F.col("y2"), F.col("x0") - F.col("x2"))})
    start, enter, out = ["x0", "y0", "z0"], ["x1", "y1", "z1"], ["x2", "y2", "z2"]
    points = F.concat(_turn(0, "yaw0", "yaw1", start, yaw_step), _fly(1, start, enter, "yaw1", step), _turn(2, "yaw1", "yaw2", enter, yaw_step), orbit_points, _turn(4, "yaw3", "yaw4", out, yaw_step), _fly(5, out, start, "yaw4", step))
    return numbered(t.withColumn("points", points).select("name", "k", "radius", "points"), ["name", "k"])


# Outlines, roads and meshes: each object's path is made by a kernel in an Arrow batch.


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(n > 1e-12, n, 1.0)


def along(path: np.ndarray, step: float, closed: bool = False) -> np.ndarray:
    """Points at equal steps along a path; a closed one does not repeat its first."""
    p = np.vstack((path, path[:1])) if closed else path
    s = np.concatenate(([0.0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))))
    if s[-1] < 1e-9:
        return path[:1]
    if closed:
        at = np.linspace(0.0, s[-1], max(3, int(s[-1] // step)), endpoint=False)
    else:
        at = np.arange(int(s[-1] // step) + 1) * step
        at = np.append(at, s[-1]) if at[-1] < s[-1] - 1e-9 else at
    return np.stack([np.interp(at, s, p[:, i]) for i in range(p.shape[1])], axis=1)


def smooth(path: np.ndarray, window: int, closed: bool) -> np.ndarray:
    if len(path) < 3 or window <= 1:
        return path
    half = window // 2
    width = window if closed else 2 * half + 1
    padded = np.concatenate((path[-half:], path, path[:half])) if closed else np.pad(path, ((half, half), (0, 0)), mode="edge")
    sums = np.concatenate((np.zeros((1, path.shape[1])), np.cumsum(padded, axis=0)))
    return (sums[width : width + len(path)] - sums[: len(path)]) / width


def headings(path: np.ndarray, closed: bool) -> np.ndarray:
    d = (np.roll(path, -1, axis=0) - path) if closed else np.vstack((np.diff(path, axis=0), path[-1:] - path[-2:-1]))
    return np.arctan2(d[:, 1], d[:, 0])


def turns(a: float, b: float, step_deg: float) -> np.ndarray:
    d = (b - a + math.pi) % (2 * math.pi) - math.pi
    if abs(math.degrees(d)) < 1e-3:
        return np.zeros(0)
    n = max(1, int(abs(math.degrees(d)) / step_deg + 1e-9))
    return a + d * np.arange(1, n + 1) / n


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull, counter-clockwise, without points on its edges."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def long_side(points: np.ndarray) -> float:
    """The angle, in [0, pi), of the longer side of the smallest rectangle around the points; it lies
    along an edge of their hull."""
    h = hull(points)
    if len(h) < 2:
        return 0.0
    edges = np.roll(h, -1, axis=0) - h
    best = (math.inf, 0.0)
    for angle in np.arctan2(edges[:, 1], edges[:, 0]):
        c, s = math.cos(angle), math.sin(angle)
        size = np.ptp(h @ np.array([[c, -s], [s, c]]), axis=0)
        best = min(best, (round(float(size[0] * size[1]), 9), float(angle if size[0] >= size[1] else angle + math.pi / 2) % math.pi))
    return best[1]


def sweep(ring: np.ndarray, spacing: float, angle: float | None = None) -> np.ndarray:
    """Back-and-forth lines over a polygon, `spacing` apart, along the longer side of the smallest
    rectangle around it unless told."""
    if angle is None:
        angle = long_side(ring)
    c, s = math.cos(angle), math.sin(angle)
    turned = ring @ np.array([[c, -s], [s, c]])
    nxt = np.roll(turned, -1, axis=0)
    lo, hi = turned[:, 1].min(), turned[:, 1].max()
    lines = lo + spacing / 2 + spacing * np.arange(max(1, math.ceil((hi - lo) / spacing - 0.5)))
    out = []
    for k, y in enumerate(lines[lines < hi] if (lines < hi).any() else [(lo + hi) / 2]):
        hit = (turned[:, 1] <= y) != (nxt[:, 1] <= y)
        x = np.sort(turned[hit, 0] + (y - turned[hit, 1]) / (nxt[hit, 1] - turned[hit, 1]) * (nxt[hit, 0] - turned[hit, 0]))
        ends = [(a, b) for a, b in zip(x[::2], x[1::2], strict=False)]
        for a, b in ends if k % 2 == 0 else [(b, a) for a, b in reversed(ends)]:
            out += [(a, y), (b, y)]
    return np.array(out).reshape(-1, 2) @ np.array([[c, s], [-s, c]])


class Path:
    """Points of one trajectory, stage by stage."""

    def __init__(self, at: np.ndarray, yaw: float, step: float, yaw_step: float):
        self.at, self.yaw, self.step, self.yaw_step = np.asarray(at, float), yaw, step, yaw_step
        self.points: list[tuple] = []

    def turn(self, stage: int, yaw: float) -> None:
        for a in turns(self.yaw, yaw, self.yaw_step):
            self.points.append((stage, *self.at, float(a)))
            self.yaw = float(a)

    def fly(self, stage: int, to: np.ndarray) -> None:
        path = along(np.stack((self.at, np.asarray(to, float))), self.step)[1:]
        self.points += [(stage, *p, self.yaw) for p in path]
        self.at = np.asarray(to, float)

    def follow(self, stage: int, xy: np.ndarray, yaws: np.ndarray) -> None:
        for p, a in zip(xy, yaws, strict=True):
            self.points.append((stage, *p, self.at[2], float(a)))
        if len(xy):
            self.at, self.yaw = np.array([*xy[-1], self.at[2]]), float(yaws[-1])


def inspect_building(xy: np.ndarray, z: float, rng: np.random.Generator, expand: float = 8.0, window: int = 9, iterations: int = 2, step: float = 1.0, yaw_step: float = 5.0, radius: float = 60.0) -> list[tuple]:
    """Stages: move over, descend, turn, loop, ascend, return."""
    ring = along(grow_ring(xy, expand), step, closed=True)
    for _ in range(iterations):
        ring = smooth(ring, window, closed=True)
    angle, r, high = rng.uniform(0, 2 * math.pi), radius * math.sqrt(rng.random()), z + rng.uniform(60, 80)
    start = np.array([*(xy.mean(axis=0) + r * np.array([math.cos(angle), math.sin(angle)])), high])
    first = int(np.argmin(np.linalg.norm(ring - start[:2], axis=1)))
    loop = np.roll(ring, -first, axis=0)
    p = Path(start, rng.uniform(-math.pi, math.pi), step, yaw_step)
    p.fly(0, np.array([*loop[0], high]))
    p.fly(1, np.array([*loop[0], z]))
    yaws = headings(loop, closed=True)
    p.turn(2, float(yaws[0]))
    p.follow(3, np.vstack((loop[1:], loop[:1])), np.append(yaws[1:], yaws[0]))
    p.fly(4, np.array([*loop[0], high]))
    p.fly(5, start)
    return p.points


def both_ways(kernel: Callable[..., list[tuple]]) -> Callable[..., list[tuple]]:
    """A kernel of roads that goes from the head for even k and from the tail for odd k."""

    def run(xy: np.ndarray, z: float, rng: np.random.Generator, k: int = 0) -> list[tuple]:
        return kernel(xy, z, rng, backwards=bool(k % 2))

    run.by_k = True
    return run


def follow_road(xy: np.ndarray, z: float, rng: np.random.Generator, inset: float = 0.0, window: int = 9, step: float = 0.1, yaw_step: float = 0.5, backwards: bool = False) -> list[tuple]:
    """Stages: move over, descend, turn, follow, ascend."""
    path = xy[::-1] if backwards else xy
    line = along(path, step)
    cut = int(inset / step)
    line = smooth(line[cut : len(line) - cut] if len(line) > 2 * cut + 1 else line, window, closed=False)
    if len(line) < 2:
        return []
    d = unit(smooth(np.stack((np.cos(h := headings(line, closed=False)), np.sin(h)), axis=1), window, closed=False))
    yaws, high = np.arctan2(d[:, 1], d[:, 0]), z + rng.uniform(60, 80)
    angle, r = rng.uniform(0, 2 * math.pi), 40 * math.sqrt(rng.random())
    p = Path(np.array([*(line[0] + r * np.array([math.cos(angle), math.sin(angle)])), high]), rng.uniform(-math.pi, math.pi), max(step, 1.0), yaw_step)
    p.fly(0, np.array([*line[0], high]))
    p.fly(1, np.array([*line[0], z]))
    p.turn(2, float(yaws[0]))
    p.follow(3, line[1:], yaws[1:])
    p.fly(4, np.array([*line[-1], high]))
    return p.points


def map_field(xy: np.ndarray, z: float, rng: np.random.Generator, swath: float = 40.0, overlap: float = 0.2, step: float = 1.0, yaw_step: float = 5.0, expand: float = 0.0) -> list[tuple]:
    """Stages: descend, turn, sweep, ascend."""
    corners = sweep(grow_ring(xy, expand), max(0.1, swath * (1 - overlap)))
    if len(corners) < 2:
        return []
    line, high = along(corners, step), z + rng.uniform(60, 80)
    yaws = headings(line, closed=False)
    p = Path(np.array([*line[0], high]), rng.uniform(-math.pi, math.pi), step, yaw_step)
    p.fly(0, np.array([*line[0], z]))
    p.turn(1, float(yaws[0]))
    p.follow(2, line[1:], yaws[1:])
    p.fly(3, np.array([*line[-1], high]))
    return p.points


def clearance(points: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest of the triangles (n, 3, 3); infinite without any."""
    if not len(tri):
        return np.full(len(points), np.inf)
    p, a = points[:, None, :], tri[None, :, 0]
    e, f = tri[None, :, 1] - a, tri[None, :, 2] - a
    w = p - a
    ee, ef, ff, we, wf = (np.sum(x * y, axis=-1) for x, y in ((e, e), (e, f), (f, f), (w, e), (w, f)))
    det = ee * ff - ef * ef
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v = (we * ff - wf * ef) / det, (wf * ee - we * ef) / det
    inner = (det > 1e-18) & (u >= 0) & (v >= 0) & (u + v <= 1)
    flat = w - np.where(inner, u, 0.0)[..., None] * e - np.where(inner, v, 0.0)[..., None] * f
    d2 = np.where(inner, np.sum(flat * flat, axis=-1), np.inf)
    for i, j in ((0, 1), (1, 2), (2, 0)):  # beyond the plane's part above the triangle, an edge is nearest
        start, way = tri[None, :, i], tri[None, :, j] - tri[None, :, i]
        t = np.clip(np.sum((p - start) * way, axis=-1) / np.maximum(np.sum(way * way, axis=-1), 1e-18), 0, 1)
        off = p - start - t[..., None] * way
        d2 = np.minimum(d2, np.sum(off * off, axis=-1))
    return np.sqrt(d2.min(axis=1))


def edge_distance(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of the segment a-b to each of the segments p-q (n, 3)."""
    d, e, r = b - a, q - p, a - p
    dd, ee, de, dr, er = d @ d, np.sum(e * e, axis=1), e @ d, r @ d, np.sum(e * r, axis=1)
    det = dd * ee - de * de
    s = np.clip(np.where(det > 1e-15, (de * er - dr * ee) / np.where(det > 1e-15, det, 1.0), 0.0), 0, 1)
    t = np.clip((de * s + er) / np.maximum(ee, 1e-18), 0, 1)
    s = np.clip((de * t - dr) / max(dd, 1e-18), 0, 1)
    off = r + s[:, None] * d - t[:, None] * e
    return np.linalg.norm(off, axis=1)


def crosses(a: np.ndarray, b: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Whether the segment a-b goes through each triangle."""
    d, e, f, s = b - a, tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0], a - tri[:, 0]
    h, q = np.cross(d, f), np.cross(s, e)
    det = np.sum(e * h, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v, t = np.sum(s * h, axis=1) / det, (q @ d) / det, np.sum(f * q, axis=1) / det
    return (np.abs(det) > 1e-14) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0) & (t <= 1)


def segment_free(a: np.ndarray, b: np.ndarray, tri: np.ndarray, radius: float) -> bool:
    """Whether the segment keeps more than the radius from every triangle.

    Only triangles whose boxes, widened by the radius, meet the segment's box are measured: through a
    triangle, else the nearest of its edges to the segment and of the segment's ends to it.
    """
    lo, hi = np.minimum(a, b) - radius, np.maximum(a, b) + radius
    near = tri[np.all((tri.min(axis=1) <= hi) & (tri.max(axis=1) >= lo), axis=1)] if len(tri) else tri
    if not len(near):
        return True
    if crosses(a, b, near).any():
        return False
    if any((edge_distance(a, b, near[:, i], near[:, j]) <= radius).any() for i, j in ((0, 1), (1, 2), (2, 0))):
        return False
    return bool((clearance(np.stack((a, b)), near) > radius).all())


def plan_around(start: np.ndarray, goal: np.ndarray, tri: np.ndarray, rng: np.random.Generator, radius: float = 3.0, step: float = 1.0, bias: float = 0.1, iterations: int = 15_000, spread: float = 15.0) -> np.ndarray | None:
    """A rapidly growing random tree from start to goal; None if the budget does not reach it."""
    if segment_free(start, goal, tri, radius):
        return np.stack((start, goal))
    nodes, parent = np.empty((iterations + 1, 3)), np.empty(iterations + 1, np.int64)
    nodes[0], n = start, 1
    lo, hi = np.minimum(start, goal) - spread, np.maximum(start, goal) + spread
    for _ in range(iterations):
        target = goal if rng.random() < bias else rng.uniform(lo, hi)
        i = int(np.argmin(((nodes[:n] - target) ** 2).sum(axis=1)))
        way = target - nodes[i]
        length = np.linalg.norm(way)
        new = nodes[i] + way * min(1.0, step / max(length, 1e-9))
        if not segment_free(nodes[i], new, tri, radius):
            continue
        nodes[n], parent[n] = new, i
        n += 1
        if np.linalg.norm(new - goal) <= step and segment_free(new, goal, tri, radius):
            out, i = [goal], n - 1
            while i:
                out.append(nodes[i])
                i = int(parent[i])
            return np.array([start, *out[::-1]])
    return None


def shorten(path: np.ndarray, tri: np.ndarray, rng: np.random.Generator, radius: float, tries: int = 300) -> np.ndarray:
    """Replaces stretches by straight segments that are free."""
    pts = list(path)
    for _ in range(tries):
        if len(pts) < 3:
            break
        i, j = sorted(rng.choice(len(pts), 2, replace=False))
        if j > i + 1 and segment_free(pts[i], pts[j], tri, radius):
            del pts[i + 1 : j]
    return np.array(pts)


def rounded_corners(path: np.ndarray, iterations: int = 8) -> np.ndarray:
    for _ in range(iterations if len(path) > 2 else 0):
        a, b = path[:-1], path[1:]
        path = np.vstack((path[:1], np.stack((0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b), axis=1).reshape(-1, path.shape[1]), path[-1:]))
    return path


def traverse(start: np.ndarray, goal: np.ndarray, tri: np.ndarray, seed: int, radius: float = 3.0, step: float = 0.3, yaw_step: float = 5.0, attempts: int = 50) -> list[tuple]:
    """Stages: turn, fly around obstacles.  Attempt i draws from seed + i; none found: no points."""
    for i in range(attempts):
        rng = np.random.default_rng(seed + i)
        if (path := plan_around(start, goal, tri, rng, radius)) is None:
            continue
        short = shorten(path, tri, rng, radius)
        soft = rounded_corners(short)
        if not all(segment_free(a, b, tri, radius * 0.5) for a, b in zip(soft[:-1], soft[1:], strict=True)):
            soft = short
        line = along(soft, step)
        yaws = headings(line, closed=False)
        for j in range(1, len(yaws)):
            x, y = 0.75 * math.cos(yaws[j - 1]) + 0.25 * math.cos(yaws[j]), 0.75 * math.sin(yaws[j - 1]) + 0.25 * math.sin(yaws[j])
            yaws[j] = math.atan2(y, x)
        points = [(0, *line[0], float(a)) for a in turns(float(rng.uniform(-math.pi, math.pi)), float(yaws[0]), yaw_step)]
        return points + [(1, *p, float(a)) for p, a in zip(line[1:], yaws[1:], strict=True)]
    return []


def from_outlines(outlines: DataFrame, per: int, seed: int, kernel: Callable[[np.ndarray, float, np.random.Generator], list[tuple]]) -> DataFrame:
    """outlines: (name, pts array<struct<x,y,...>>, target_z).  `per` trajectories each, made by the
    kernel in Arrow batches; the generator is seeded by (seed, name, k)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, k, pts, z, s in zip(b["name"], b["k"], b["pts"], b["target_z"], b["s"], strict=True):
                xy = np.array([(p["x"], p["y"]) for p in pts], float)
                rng = np.random.default_rng(int(s) & (1 << 63) - 1)
                points = kernel(xy, float(z), rng, int(k)) if getattr(kernel, "by_k", False) else kernel(xy, float(z), rng)
                rows.append((name, k, [dict(zip(("stage", "x", "y", "z", "yaw"), map(float, p), strict=True)) | {"stage": int(p[0])} for p in points]))
            yield pd.DataFrame(rows, columns=["name", "k", "points"])

    t = _trajectories(outlines, per).withColumn("s", F.xxhash64(F.lit(seed), "name", "k")).select("name", "k", "pts", "target_z", "s")
    return numbered(t.repartition("name", "k").mapInPandas(run, f"name string, k int, points {POINT}"), ["name", "k"])


def from_pairs(pairs: DataFrame, triangles: DataFrame, seed: int = 42, radius: float = 3.0, spread: float = 15.0, **options) -> DataFrame:
    """pairs: (env_id, name, k, sx..gz).  Traversals, each with the triangles of its scene that a path may
    come near: those that meet the box of its search, widened by the radius."""
    ends = {c: [F.col(f"s{c}"), F.col(f"g{c}")] for c in "xyz"}
    reach = spread + radius
    meets = reduce(Column.__and__, [(F.greatest(*[F.col(f"{v}{c}") for v in "abc"]) >= F.least(*ends[c]) - reach) & (F.least(*[F.col(f"{v}{c}") for v in "abc"]) <= F.greatest(*ends[c]) + reach) for c in "xyz"])
    corners = F.array(*[F.col(f"{v}{c}") for v in "abc" for c in "xyz"])
    near = pairs.join(triangles, "env_id").filter(meets).groupBy("name", "k").agg(F.collect_list(corners).alias("tri"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                mesh = np.array([np.asarray(t, float) for t in r.tri]).reshape(-1, 3, 3) if r.tri is not None else np.zeros((0, 3, 3))
                points = traverse(np.array([r.sx, r.sy, r.sz]), np.array([r.gx, r.gy, r.gz]), mesh, seed + int(r.k), radius, **options)
                rows.append((r.name, r.k, [{"stage": int(p[0]), **dict(zip(("x", "y", "z", "yaw"), map(float, p[1:]), strict=True))} for p in points]))
            yield pd.DataFrame(rows, columns=["name", "k", "points"])

    t = pairs.join(near, ["name", "k"], "left").repartition("name", "k")
    return numbered(t.mapInPandas(run, f"name string, k int, points {POINT}"), ["name", "k"])
