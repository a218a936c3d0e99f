"""Segments and triangles, by blocks, against every pair."""

import numpy as np
import pytest

from skytrail.operators import hits
from skytrail.sources import scratch

TRI = "env_id string, " + ", ".join(f"{c} double" for c in hits.CORNERS)
SEG = "env_id string, k string, " + ", ".join(f"{c} double" for c in hits.ENDS)


def soup(rng, n, spread, size, at):
    return (rng.uniform(0, spread, (n, 1, 3)) + rng.normal(size=(n, 3, 3)) * size + at).reshape(n, 9)


def brute(seg, tri):
    p, d = seg[:, :3], seg[:, 3:] - seg[:, :3]
    length = np.sqrt((d * d).sum(1))
    out = np.full(len(seg), np.inf)
    for i in np.flatnonzero(length > 1e-12):
        one = lambda v: np.broadcast_to(v, (len(tri), *np.shape(v)))
        ok, at = hits.exact(one(p[i]), one(d[i] / length[i]), one(length[i]), tri[:, :3], tri[:, 3:6], tri[:, 6:])
        out[i] = at[ok].min(initial=np.inf)
    return out


@pytest.mark.parametrize("spread,size,at", [(1.0, 0.3, 0.0), (10.0, 0.5, 0.0), (60.0, 4.0, 500_000.0)])
@pytest.mark.parametrize("shuffled", [False, True])
def test_hits_of_every_pair(spark, monkeypatch, spread, size, at, shuffled):
    """Many blocks and tiles, sparse and dense, near and far from the origin; joined with and without a broadcast."""
    monkeypatch.setattr(hits, "TRIANGLES", 300)
    monkeypatch.setattr(hits, "SEGMENTS", 64)
    if shuffled:
        monkeypatch.setattr(scratch, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(int(spread))
    tri = {e: soup(rng, 1500, spread, size, at) for e in "ab"}
    tri["a"][:40, 3:6] = tri["a"][:40, :3]  # without area
    seg = {e: np.concatenate([p := rng.uniform(0, spread, (200, 3)) + at, p + rng.normal(size=(200, 3)) * size], axis=1) for e in "abc"}
    seg["b"][:5, 3:] = seg["b"][:5, :3]  # without length
    t = spark.createDataFrame([(e, *map(float, r)) for e in tri for r in tri[e]] + [("a", None, *[0.0] * 8), (None, *[0.0] * 9)], TRI)
    s = spark.createDataFrame([(e, f"{e}{i // 4}" if i < 196 else None, *map(float, r)) for e in seg for i, r in enumerate(seg[e])] + [("a", "a0", None, *[0.0] * 5)], SEG)
    want = {}
    for e in tri:
        for i, v in enumerate(brute(seg[e], tri[e])):
            k = f"{e}{i // 4}" if i < 196 else None
            if np.isfinite(v):
                want[k] = min(want.get(k, np.inf), v)
    got = {r.k: r.distance for r in hits.segment_hits(s, t, ["env_id"], ["k"]).collect()}
    assert len(want) > 10 and got == want
    assert {r.k for r in hits.segment_hits(s, t, ["env_id"], ["k"], nearest=False).collect()} == set(want)


def test_no_triangles_no_hits(spark):
    s = spark.createDataFrame([("a", "x", *[0.0] * 3, *[1.0] * 3)], SEG)
    assert hits.segment_hits(s, spark.createDataFrame([], TRI), ["env_id"], ["k"]).count() == 0


def test_few_pairs_of_a_dense_mesh_reach_the_exact_test(monkeypatch):
    """The time of a dense mesh, by the pairs that are measured exactly: under a fiftieth of all."""
    rng = np.random.default_rng(3)
    seen, exact = [0], hits.exact
    monkeypatch.setattr(hits, "exact", lambda p, *rest: (seen.__setitem__(0, seen[0] + len(p)), exact(p, *rest))[1])
    p = rng.uniform(0, 1, (980, 3))
    tri = soup(rng, 8000, 1.0, 0.2, 0.0)
    for nearest in (True, False):
        seen[0] = 0
        hits.Block(np.concatenate([p, p + rng.normal(size=p.shape) * 0.3], axis=1), (np.arange(980) // 49).astype(np.int32), 20, nearest).meet(tri)
        assert 0 < seen[0] < 980 * 8000 / 50


@pytest.mark.parametrize("shuffled", [False, True])
@pytest.mark.parametrize("front", [1, 1000, 10**9])
def test_a_front_of_any_size_settles_no_path_wrongly(spark, monkeypatch, front, shuffled):
    """None, some or all of the mesh goes first: the paths that hit are the same."""
    monkeypatch.setattr(hits, "TRIANGLES", 300)
    monkeypatch.setattr(hits, "SEGMENTS", 64)
    monkeypatch.setattr(hits, "FRONT", front)
    if shuffled:
        monkeypatch.setattr(scratch, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(5)
    tri = {e: soup(rng, 1500, 10.0, 0.3, 0.0) for e in "ab"}
    seg = {e: np.concatenate([p := rng.uniform(0, 10, (400, 3)), p + rng.normal(size=(400, 3)) * 0.5], axis=1) for e in "abc"}
    t = spark.createDataFrame([(e, *map(float, r)) for e in tri for r in tri[e]], TRI)
    s = spark.createDataFrame([(e, f"{e}{i // 4}" if i < 396 else None, *map(float, r)) for e in seg for i, r in enumerate(seg[e])], SEG)
    want = {f"{e}{i // 4}" if i < 396 else None for e in tri for i in np.flatnonzero(np.isfinite(brute(seg[e], tri[e])))}
    got = [r.k for r in hits.segment_hits(s, t, ["env_id"], ["k"], nearest=False).collect()]
    assert 10 < len(want) < 190 and len(got) == len(want) and set(got) == want


def test_paths_that_hit_the_front_are_not_packed(spark):
    """Only the others travel to the rest of the mesh."""
    wall = np.array([[0.5, -9.0, -9.0, 0.5, 9.0, -9.0, 0.5, 0.0, 9.0]])
    rows = [(e, f"{e}{k}", float(k % 2), 0.0, 0.0, k % 2 + 0.9, 0.0, 0.0) for e in "ab" for k in range(10)]
    blocks = hits.packed(spark.createDataFrame(rows, SEG).coalesce(1), ["env_id"], ["k"], hits.ENDS, 64, {("a",): wall}).collect()
    assert {k.k for b in blocks if not b._data for k in b._keys} == {f"a{k}" for k in range(0, 10, 2)}
    left = [b for b in blocks if b._data]
    assert {k.k for b in left for k in b._keys} == {f"a{k}" for k in range(1, 10, 2)} | {f"b{k}" for k in range(10)}
    assert sum(len(b._data) for b in left) == 15 * 48 and len({b._id for b in blocks}) == len(blocks)
