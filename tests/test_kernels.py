"""Plane and space kernels against plain sampling."""

import math

import numpy as np
from pyspark.sql import functions as F

from skytrail.operators import evaluate, generators, tables
from skytrail.sources import media


def sampled(tri, n=60):
    """Points all over a triangle."""
    u, v = (x.ravel() for x in np.meshgrid(np.linspace(0, 1, n), np.linspace(0, 1, n)))
    u, v = u[u + v <= 1], v[u + v <= 1]
    return tri[0] + u[:, None] * (tri[1] - tri[0]) + v[:, None] * (tri[2] - tri[0])


def test_clearance_is_the_distance_to_the_nearest_point():
    rng = np.random.default_rng(3)
    tris, points = rng.uniform(-2, 2, (6, 3, 3)), rng.uniform(-4, 4, (30, 3))
    cloud = np.concatenate([sampled(t) for t in tris])
    near = np.sqrt(((points[:, None] - cloud[None]) ** 2).sum(-1)).min(1)
    got = generators.clearance(points, tris)
    assert (got <= near + 1e-9).all() and (near - got < 0.1).all()
    assert np.isinf(generators.clearance(points, np.zeros((0, 3, 3)))).all()


def test_segments_are_free_by_their_true_distance():
    rng = np.random.default_rng(4)
    for _ in range(200):
        tri = rng.uniform(-2, 2, (1, 3, 3))
        a, b = rng.uniform(-4, 4, (2, 3))
        line = a + np.linspace(0, 1, 120)[:, None] * (b - a)
        least = generators.clearance(line, tri).min()
        if least > 0.55:
            assert generators.segment_free(a, b, tri, 0.5)
        if least < 0.5:
            assert not generators.segment_free(a, b, tri, 0.5)


def test_smallest_rectangle_lies_along_its_long_side():
    for angle in np.linspace(0, math.pi, 13, endpoint=False):
        c, s = math.cos(angle), math.sin(angle)
        box = np.array([(0, 0), (9, 0), (9, 2), (4, 1.5), (0, 2)]) @ np.array([[c, s], [-s, c]])
        off = (generators.long_side(box) - angle + math.pi / 2) % math.pi - math.pi / 2
        assert abs(off) < 1e-9


def test_png_round_trip_with_all_row_filters():
    rng = np.random.default_rng(5)
    for dtype, channels in ((np.uint8, 3), (np.uint16, 1), (np.uint8, 4)):
        image = rng.integers(0, np.iinfo(dtype).max, (7, 5, channels), dtype=dtype)
        assert np.array_equal(media.decode_png(media.encode_png(image)), image)
    # Row filters 1 to 4, made by their definition.
    import struct
    import zlib

    image = rng.integers(0, 256, (5, 6, 3), dtype=np.uint8)
    flat = image.reshape(5, 18).astype(int)
    rows = []
    for y in range(5):
        above = flat[y - 1] if y else np.zeros(18, int)
        left, corner = np.concatenate(([0] * 3, flat[y][:-3])), np.concatenate(([0] * 3, above[:-3]))
        p = left + above - corner
        dist = [abs(p - left), abs(p - above), abs(p - corner)]
        paeth = np.where((dist[0] <= dist[1]) & (dist[0] <= dist[2]), left, np.where(dist[1] <= dist[2], above, corner))
        guess = [0 * left, left, above, (left + above) // 2, paeth][y]
        rows.append(bytes([y]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes())
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    png = media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert np.array_equal(media.decode_png(png), image)


def test_soft_dtw_of_long_paths_needs_no_matrix():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(3000, 4)), rng.normal(size=(2500, 4))
    assert math.isfinite(evaluate.soft_dtw(a, b, 0.1, 0.5))


def test_first_hit_distance(spark):
    wall = [("e", x, -9.0, -9.0, x, 9.0, -9.0, x, 0.0, 20.0) for x in (3.0, 7.0)]
    tri = spark.createDataFrame(wall, "env_id string, " + ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz"))
    seg = spark.createDataFrame([("e", 1, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0), ("e", 2, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0), ("e", 3, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("f", 4, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0)], "env_id string, k long, " + ", ".join(f"p{i}{c} double" for i in (0, 1) for c in "xyz"))
    got = {r.k: round(r.distance, 9) for r in evaluate.segment_hits(seg, tri, ["env_id"], ["k"]).collect()}
    assert got == {1: 3.0, 3: 3.0}


def test_resize_by_its_definition():
    rng = np.random.default_rng(8)
    for shape, to in (((7, 5, 3), (4, 9)), ((12, 10, 1), (3, 3)), ((2, 3, 4), (8, 8)), ((300, 40, 3), (256, 256))):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        got = media.resize(image, *to)
        want = image.astype(float)
        for axis, size in ((1, to[1]), (0, to[0])):
            scale, lines = want.shape[axis] / size, []
            for i in range(size):
                at, wide = (i + 0.5) * scale, max(scale, 1.0)
                w = np.array([max(0.0, 1 - abs(j + 0.5 - at) / wide) for j in range(want.shape[axis])])
                lines.append(np.tensordot(w / w.sum(), want, axes=(0, axis)))
            want = np.stack(lines, axis=axis)
        assert got.shape == (*to, shape[2]) and np.abs(got - want).max() <= 1.001
    flat = np.full((9, 11, 3), 200, np.uint8)
    assert (media.resize(flat, 256, 256) == 200).all() and np.array_equal(media.resize(image, *image.shape[:2]), image)
    both = media.side_by_side(flat, np.zeros((18, 4, 3), np.uint8))
    assert both.shape == (18, 22 + 4, 3) and (both[:, :22] == 200).all() and (both[:, 22:] == 0).all()


def test_resized_png_of_a_column(spark):
    image = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    df = spark.createDataFrame([(1, bytearray(media.encode_png(image))), (2, None)], "k int, png binary")
    got = {r.k: r.png for r in df.selectExpr("k", "png", "2 h", "6 w").select("k", media.resized_png("png", "h", "w").alias("png")).collect()}
    assert np.array_equal(media.decode_png(bytes(got[1])), media.resize(image, 2, 6)) and got[2] is None


def test_counts_come_with_the_job(spark):
    df, seen = tables.counted(spark.range(100), "frames", even=F.col("id") % 2 == 0, none=F.lit(None).cast("boolean"))
    assert df.count() == 100
    assert seen.get == {"rows": 100, "even": 50, "none": 0}
