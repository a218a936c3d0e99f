"""Grown outlines and decimated meshes against their definitions."""

import math

import numpy as np
import pytest

from skytrail.operators import outlines


def distance(points, ring):
    """Of each point to a closed ring."""
    a, d = ring, np.roll(ring, -1, axis=0) - ring
    rel = points[:, None] - a
    t = np.clip((rel * d).sum(2) / (d * d).sum(1), 0, 1)
    return np.linalg.norm(rel - t[..., None] * d, axis=2).min(1)


def star(rng, n):
    angle = np.sort(rng.uniform(0, 2 * math.pi, n))
    return rng.uniform(4, 20, n)[:, None] * np.stack((np.cos(angle), np.sin(angle)), axis=1)


def test_grown_ring_bounds_all_within_the_distance():
    rng = np.random.default_rng(1)
    for n in (3, 4, 5, 8, 13, 30):
        for d in (0.5, 3.0, 9.0):
            ring = star(rng, n)
            for r in (ring, ring[::-1]):
                grown = outlines.grow_ring(r, d, resolution=64)
                points = rng.uniform(-32, 32, (4000, 2))
                apart = np.where(outlines.winding(points, ring if outlines.signed_area(ring) > 0 else ring[::-1]) > 0, 0.0, distance(points, ring))
                inside = outlines.winding(points, grown) > 0
                assert inside[apart < d * 0.995].all()
                # What lies outside the outer boundary is further; holes belong to its inside.
                assert (distance(grown, ring) < d + 1e-6).all() and outlines.signed_area(grown) > 0
                assert (distance(grown, ring) > d * 0.998).all()


def test_grown_ring_of_a_narrow_bay_does_not_cross_itself():
    bay = np.array([(0, 0), (10, 0), (10, 10), (6, 10), (6, 2), (4, 2), (4, 10), (0, 10)], float)
    grown = outlines.grow_ring(bay, 2.0, join="mitre")
    assert abs(outlines.signed_area(grown) - 14 * 14) < 1e-6


def test_joins():
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1)], float)
    assert abs(outlines.signed_area(outlines.grow_ring(square, 1.0, join="mitre")) - 9) < 1e-9
    assert abs(outlines.signed_area(outlines.grow_ring(square, 1.0, join="bevel")) - 7) < 1e-9
    assert abs(outlines.signed_area(outlines.grow_ring(square, 1.0, resolution=200)) - (5 + math.pi)) < 1e-3
    assert outlines.grow_ring(square, 0.0) is not None and len(outlines.grow_ring(square[:2], 3.0)) == 2
    assert np.array_equal(outlines.grow_ring(np.repeat(square, 3, axis=0), 1.0), outlines.grow_ring(square, 1.0))


def test_thin_ring_stays_within_the_tolerance():
    rng = np.random.default_rng(2)
    ring = outlines.grow_ring(star(rng, 20), 2.0)
    thin = outlines.thin_ring(ring, 0.3)
    assert 3 <= len(thin) < len(ring) and (distance(ring, thin) <= 0.3 + 1e-9).all()


def ball(n):
    """A closed surface of 8 * 4**n faces."""
    p = [np.array(x, float) for x in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    faces = [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)]
    for _ in range(n):
        middle, out = {}, []

        def half(a, b, middle=middle):
            k = (min(a, b), max(a, b))
            if k not in middle:
                m = p[a] + p[b]
                middle[k] = len(p)
                p.append(m / np.linalg.norm(m))
            return middle[k]

        for a, b, c in faces:
            x, y, z = half(a, b), half(b, c), half(c, a)
            out += [(a, x, z), (x, b, y), (z, y, c), (x, y, z)]
        faces = out
    return np.array(p), np.array(faces)


def test_decimated_ball_is_closed_and_near():
    points, faces = ball(3)
    tri = outlines.decimate(points, faces, 128)
    assert 120 <= len(tri) <= 128
    corner = {}
    ids = [[corner.setdefault(tuple(np.round(v, 9)), len(corner)) for v in t] for t in tri]
    edges = [tuple(e) for t in ids for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
    assert len(set(edges)) == len(edges) and all((b, a) in set(edges) for a, b in edges)
    assert len(corner) - len(edges) // 2 + len(tri) == 2
    radius = np.linalg.norm(tri.mean(axis=1), axis=1)
    assert radius.min() > 0.88 and radius.max() < 1.05


def test_decimated_plane_keeps_its_border():
    n = 9
    points = np.array([(x, y, 0.0) for y in range(n) for x in range(n)])
    faces = [f for y in range(n - 1) for x in range(n - 1) for f in ((y * n + x, y * n + x + 1, y * n + n + x), (y * n + x + 1, y * n + n + x + 1, y * n + n + x))]
    tri = outlines.decimate(points, np.array(faces), 8)
    area = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
    assert len(tri) <= 8 and (area[:, 2] > 0).all() and abs(area[:, 2].sum() / 2 - (n - 1) ** 2) < 1e-6


def test_blocks_are_decimated_apart(spark):
    points, faces = ball(2)
    v = spark.createDataFrame([(b, 10 + i, *map(float, p * (k + 1))) for k, b in enumerate("xy") for i, p in enumerate(points)], "block string, i long, x double, y double, z double")
    f = spark.createDataFrame([(b, i, [int(w) + 10 for w in t]) for b in "xy" for i, t in enumerate(faces)], "block string, face long, idx array<long>")
    got = {r.block: r["count"] for r in outlines.decimate_blocks(v, f, 0.5).groupBy("block").count().collect()}
    assert got == {"x": 64, "y": 64}
    assert outlines.decimate_blocks(v, f.filter("false"), 0.5).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        outlines.decimate_blocks(v, f, 0.0)
    assert outlines.decimate(points, np.zeros((0, 3), int), 4).shape == (0, 3, 3)
