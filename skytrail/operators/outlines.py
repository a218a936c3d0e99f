"""Outlines that grow and lose points, and meshes that lose triangles: kernels of one object each."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def signed_area(ring: np.ndarray) -> float:
    return float(_cross(ring, np.roll(ring, -1, axis=0)).sum() / 2)


def winding(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """How often a closed curve goes around each point, counter-clockwise."""
    a, b = ring, np.roll(ring, -1, axis=0)
    side = _cross(b - a, points[:, None] - a)
    up = (a[:, 1] <= points[:, 1:]) & (b[:, 1] > points[:, 1:]) & (side > 0)
    down = (a[:, 1] > points[:, 1:]) & (b[:, 1] <= points[:, 1:]) & (side < 0)
    return up.sum(1) - down.sum(1)


def _raw_curve(ring: np.ndarray, distance: float, join: str, resolution: int, limit: float) -> np.ndarray:
    """Each edge moved outwards, with a join at corners that bulge and a way over the corner itself at
    others: it crosses itself, but goes around the grown area at least once."""
    ahead = np.roll(ring, -1, axis=0) - ring
    ahead /= np.linalg.norm(ahead, axis=1, keepdims=True)
    normal = np.stack((ahead[:, 1], -ahead[:, 0]), axis=1)
    out: list[np.ndarray] = []
    for p, before, after, u, v in zip(ring, np.roll(normal, 1, axis=0), normal, np.roll(ahead, 1, axis=0), ahead, strict=True):
        turn = math.atan2(float(_cross(u, v)), float(u @ v))
        out.append(p + distance * before)
        if turn < 0:
            out.append(p)
        elif join == "round":
            start, n = math.atan2(before[1], before[0]), math.ceil(turn / (math.pi / 2 / resolution) - 1e-9)
            out += [p + distance * np.array([math.cos(a), math.sin(a)]) for a in start + turn * np.arange(1, n) / max(n, 1)]
        elif join == "mitre" and math.cos(turn / 2) * limit >= 1:
            middle = before + after
            out.append(p + distance * middle * 2 / (middle @ middle))
        out.append(p + distance * after)
    curve = np.array(out)
    return curve[np.linalg.norm(curve - np.roll(curve, 1, axis=0), axis=1) > 1e-9]


def _pieces(curve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The curve's segments, cut where they cross, touch or lie on one another."""
    a, d = curve, np.roll(curve, -1, axis=0) - curve
    b, length = a + d, np.linalg.norm(d, axis=1)
    rel, across = a[None] - a[:, None], _cross(d[:, None], d[None])
    with np.errstate(divide="ignore", invalid="ignore"):
        t, s = _cross(rel, d[None]) / across, _cross(rel, d[:, None]) / across
    crosses = (np.abs(across) > 1e-12) & (t > 0) & (t < 1) & (s > 0) & (s < 1)
    along = np.sum(rel * d[:, None], axis=2) / (length**2)[:, None]
    touches = (np.abs(_cross(d[:, None], rel)) < 1e-9 * length[:, None]) & (along > 0) & (along < 1)
    starts, ends = [], []
    for i in range(len(a)):
        ks = np.flatnonzero(crosses[i])
        # Of a crossing, both segments get the point that the one of the lower number gives.
        low, at = np.minimum(i, ks), np.where(ks > i, t[i, ks], s[i, ks])
        cuts = np.concatenate((a[low] + at[:, None] * d[low], a[touches[i]]))
        cuts = cuts[np.argsort((cuts - a[i]) @ d[i])]
        starts += [a[i], *cuts]
        ends += [*cuts, b[i] if i + 1 < len(a) else a[0]]
    return np.array(starts), np.array(ends)


def grow_ring(ring: np.ndarray, distance: float, join: str = "round", resolution: int = 16, limit: float = 5.0, tolerance: float = 0.0) -> np.ndarray:
    """The outer boundary, counter-clockwise, of all within `distance` of a polygon; of several, that
    around the largest area.  Corners are round (`resolution` steps a quarter), mitred (up to `limit`
    distances, else cut) or cut ("bevel").  A positive tolerance thins the points out.

    Without a distance, or with fewer than three points apart, the ring comes back as it is.
    """
    ring = np.asarray(ring, float)
    if distance <= 1e-8 or len(ring) < 3:
        return ring
    apart = ring[np.linalg.norm(ring - np.roll(ring, 1, axis=0), axis=1) > 1e-9]
    if len(apart) < 3 or abs(area := signed_area(apart)) < 1e-12:
        return ring
    curve = _raw_curve(apart if area > 0 else apart[::-1], distance, join, resolution, limit)
    starts, ends = _pieces(curve)
    way = ends - starts
    long = np.linalg.norm(way, axis=1) > 1e-9
    starts, ends, way = starts[long], ends[long], way[long]
    aside = np.stack((-way[:, 1], way[:, 0]), axis=1) / np.linalg.norm(way, axis=1, keepdims=True) * 1e-6 * distance
    middle = (starts + ends) / 2
    edge = (winding(middle + aside, curve) > 0) & (winding(middle - aside, curve) <= 0)
    key = lambda p: (round(float(p[0]) * 1e7), round(float(p[1]) * 1e7))
    follow: dict[tuple, dict[tuple, np.ndarray]] = {}
    for p, q in zip(starts[edge], ends[edge], strict=True):
        follow.setdefault(key(p), {})[key(q)] = q
    best = np.zeros((0, 2))
    while follow:
        first = at = next(iter(follow))
        loop: list[np.ndarray] = []
        while at in follow:
            to, q = follow[at].popitem()
            if not follow[at]:
                del follow[at]
            loop.append(q)
            at = to
        if at == first and len(loop) > 2 and signed_area(np.array(loop)) > (signed_area(best) if len(best) else 0.0):
            best = np.array(loop)
    if not len(best):
        raise ValueError("the outline has no boundary at this distance")
    return thin_ring(best, tolerance) if tolerance > 1e-8 else best


def thin_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Points of a closed ring whose loss would move it by more than the tolerance; all of them, if fewer
    than three were left."""
    far = int(np.argmax(np.linalg.norm(ring - ring[0], axis=1)))
    closed, keep, spans = np.vstack((ring, ring[:1])), {0, far}, [(0, far), (far, len(ring))]
    while spans:
        i, j = spans.pop()
        if j - i < 2:
            continue
        d, rel = closed[j] - closed[i], closed[i + 1 : j] - closed[i]
        t = np.clip(rel @ d / max(float(d @ d), 1e-24), 0, 1)
        off = np.linalg.norm(rel - t[:, None] * d, axis=1)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep.add(i + 1 + k)
            spans += [(i, i + 1 + k), (i + 1 + k, j)]
    return ring[sorted(keep)] if len(keep) > 2 else ring


class _Mesh:
    """Vertices with the faces around them and their error quadrics."""

    def __init__(self, points: np.ndarray, faces: np.ndarray):
        self.p = points.astype(float).copy()
        self.faces: dict[int, tuple[int, int, int]] = {i: tuple(map(int, f)) for i, f in enumerate(faces)}
        self.around: list[set[int]] = [set() for _ in points]
        self.q = np.zeros((len(points), 4, 4))
        for i, f in self.faces.items():
            n = self.normal(f)
            size = np.linalg.norm(n)
            if size > 0:
                self._plane(f, n / size, size / 2)
            for v in f:
                self.around[v].add(i)
        for i, f in self.faces.items():
            for u, v in zip(f, f[1:] + f[:1], strict=True):
                if len(self.around[u] & self.around[v]) == 1:
                    # A border is held by a plane through it, upright on its face.
                    e = self.p[v] - self.p[u]
                    n = np.cross(e, self.normal(f))
                    if (size := np.linalg.norm(n)) > 0:
                        self._plane((u, v), n / size, float(e @ e))

    def normal(self, f: tuple) -> np.ndarray:
        a, b, c = self.p[list(f)]
        return np.cross(b - a, c - a)

    def _plane(self, on: tuple, n: np.ndarray, weight: float) -> None:
        plane = np.append(n, -n @ self.p[on[0]])
        for v in on:
            self.q[v] += weight * np.outer(plane, plane)

    def neighbours(self, v: int) -> set[int]:
        return {w for f in self.around[v] for w in self.faces[f]} - {v}

    def merged(self, u: int, v: int) -> tuple[float, np.ndarray]:
        """The least error of one point in place of two, and that point."""
        q, options = self.q[u] + self.q[v], [(self.p[u] + self.p[v]) / 2, self.p[u], self.p[v]]
        if abs(np.linalg.det(q[:3, :3])) > 1e-9 * max(float(np.trace(q[:3, :3])), 1e-30) ** 3:
            options.insert(0, np.linalg.solve(q[:3, :3], -q[:3, 3]))
        costs = [max(0.0, float(np.append(x, 1) @ q @ np.append(x, 1))) for x in options]
        k = int(np.argmin(costs))
        return costs[k], options[k]

    def may_merge(self, u: int, v: int, x: np.ndarray) -> bool:
        """No face turns over or vanishes, and the surface stays one."""
        shared = self.around[u] & self.around[v]
        if len(self.neighbours(u) & self.neighbours(v)) != len(shared) or len(shared) > 2:
            return False
        for f in (self.around[u] | self.around[v]) - shared:
            a, b, c = (x if w in (u, v) else self.p[w] for w in self.faces[f])
            new, old = np.cross(b - a, c - a), self.normal(self.faces[f])
            if new @ old <= 0.2 * np.linalg.norm(new) * np.linalg.norm(old):
                return False
        return True

    def merge(self, u: int, v: int, x: np.ndarray) -> None:
        """v goes into u, which moves to x."""
        for f in self.around[u] & self.around[v]:
            for w in self.faces.pop(f):
                self.around[w].discard(f)
        for f in self.around[v]:
            self.faces[f] = tuple(u if w == v else w for w in self.faces[f])
        self.around[u] |= self.around[v]
        self.around[v], self.p[u] = set(), x
        self.q[u] += self.q[v]


def decimate(points: np.ndarray, faces: np.ndarray, target: int) -> np.ndarray:
    """The corners (n, 3, 3) of at most `target` faces, where edges can be merged that far: that of the
    least quadric error first, none that would turn a face over or join surfaces.  Equal errors go by
    the vertices' numbers.  Faces that repeat a vertex are left out."""
    faces = np.asarray(faces, np.int64).reshape(-1, 3)
    faces = faces[(faces[:, 0] != faces[:, 1]) & (faces[:, 1] != faces[:, 2]) & (faces[:, 0] != faces[:, 2])]
    m = _Mesh(np.asarray(points, float).reshape(-1, 3), faces)
    heap: list[tuple] = []
    age = [0] * len(m.p)

    def push(u: int, v: int) -> None:
        u, v = min(u, v), max(u, v)
        cost, x = m.merged(u, v)
        heapq.heappush(heap, (cost, u, v, age[u], age[v], tuple(x)))

    for u, v in sorted({(min(e), max(e)) for f in m.faces.values() for e in zip(f, f[1:] + f[:1], strict=True)}):
        push(u, v)
    while len(m.faces) > target and heap:
        _, u, v, ua, va, at = heapq.heappop(heap)
        x = np.array(at)
        if (ua, va) != (age[u], age[v]) or not m.may_merge(u, v, x):
            continue
        m.merge(u, v, x)
        age[u] += 1
        age[v] += 1
        for w in sorted(m.neighbours(u)):
            push(u, w)
    return np.array([m.p[list(f)] for _, f in sorted(m.faces.items())]).reshape(-1, 3, 3)


TRIANGLE = ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz")


def decimate_blocks(vertices: DataFrame, faces: DataFrame, ratio: float) -> DataFrame:
    """vertices (block, i, x, y, z) and faces (block, face, idx of three) to triangles (block, ax..cz), of
    each block max(4, int(faces * ratio)).  A block is one file, and one task holds it; blocks are
    thinned out apart from one another, so that many machines share a scene.
    """
    if not 0 < ratio <= 1:
        raise ValueError("ratio must be in (0, 1]")

    def run(key: tuple, v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        v, f = v.sort_values("i"), f.sort_values("face")
        at = np.searchsorted(v["i"].to_numpy(), np.array(f["idx"].tolist(), np.int64).reshape(-1, 3))
        tri = decimate(v[["x", "y", "z"]].to_numpy(), at, max(4, int(len(f) * ratio)))
        return pd.DataFrame(tri.reshape(-1, 9), columns=[f"{p}{c}" for p in "abc" for c in "xyz"]).assign(block=key[0])[["block", *(f"{p}{c}" for p in "abc" for c in "xyz")]]

    block = vertices.schema["block"].dataType.simpleString()
    return vertices.select("block", "i", "x", "y", "z").groupBy("block").cogroup(faces.select("block", "face", "idx").groupBy("block")).applyInPandas(run, f"block {block}, {TRIANGLE}")
