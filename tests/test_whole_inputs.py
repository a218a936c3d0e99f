"""Meshes and chunks are made of every row of embeddings: brute force in numpy."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}


def triangles(vectors):
    out = {}
    for i, v in vectors.items():
        out.setdefault(f"env_{i // 20 % 3}", []).append(v[10:19].reshape(3, 3))
    return {k: np.array(v) for k, v in out.items()}


def meets(p, q, tri):
    a, b, c = tri[:, 0], tri[:, 1], tri[:, 2]
    length = math.dist(p, q)
    d = (q - p) / length
    e, f = b - a, c - a
    h, s = np.cross(d, f), p - a
    det = (e * h).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.cross(s, e)
        u, v, t = (s * h).sum(1) / det, (w * d).sum(1) / det, (f * w).sum(1) / det
        return bool(((abs(det) > 1e-14) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= -1e-8) & (t <= length + 1e-8)).any())


def test_mesh_has_every_vector(spark, vectors):
    tri = triangles(vectors)
    got = {r.env_id: r.asDict() for r in entry.queries()["mesh_bounds"](spark, DATA).collect()}
    assert set(got) == set(tri)
    for k, t in tri.items():
        for i, c in enumerate("xyz"):
            assert got[k][f"min_{c}"] == pytest.approx(t[..., i].min(), abs=1e-6) and got[k][f"max_{c}"] == pytest.approx(t[..., i].max(), abs=1e-6)


def test_collisions_with_every_triangle(spark, vectors):
    tri = triangles(vectors)
    want = {}
    for episode in {i // 50 for i in vectors}:
        path = [vectors[i][4:7] for i in range(episode * 50, episode * 50 + 50)]
        mesh = tri.get(f"env_{episode % 4}")
        want[episode] = None if mesh is None else float(any(meets(p, q, mesh) for p, q in zip(path, path[1:])))
    assert {r.episode_index: r.cr for r in entry.queries()["eval_collision"](spark, DATA).collect()} == want


@pytest.mark.parametrize("name", ["chunk_average", "stream_chunk_average"])
def test_chunks_at_every_frame(spark, vectors, name):
    want = {}
    for i, v in vectors.items():
        for k in range(8):
            want.setdefault((i // 50, i % 50 + k), []).append((v[4 * k], v[4 * k + 3]))
    got = {(r.episode, r.step): r for r in entry.queries()[name](spark, DATA).collect()}
    assert set(got) == set(want)
    for key, parts in want.items():
        dx, dyaw = np.mean(parts, axis=0)
        assert (got[key].n, got[key].dx, got[key].dyaw) == (len(parts), pytest.approx(dx, abs=2e-6), pytest.approx(dyaw, abs=2e-6))
