import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytrail.functions import angles
from skytrail.operators import evaluate


def plain_soft_dtw(truth, pred, w, gamma):
    """The recursion, cell by cell."""
    n, m = len(pred), len(truth)
    r = np.full((n + 1, m + 1), np.inf)
    r[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d = pred[i - 1] - truth[j - 1]
            a = (d[3] + math.pi) % (2 * math.pi) - math.pi
            prev = [r[i, j - 1], r[i - 1, j], r[i - 1, j - 1]]
            low = min(prev)
            soft = low - gamma * math.log(sum(math.exp((low - p) / gamma) for p in prev)) if math.isfinite(low) else math.inf
            r[i, j] = math.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2 + w * w * a * a) + soft
    return r[n, m]


@pytest.mark.parametrize("n,m", [(1, 1), (1, 7), (7, 1), (6, 9), (20, 20)])
def test_soft_dtw(n, m):
    rng = np.random.default_rng(n * 100 + m)
    a, b = rng.normal(size=(m, 4)) * 3, rng.normal(size=(n, 4)) * 3
    assert evaluate.soft_dtw(a, b, 0.1, 0.5) == pytest.approx(plain_soft_dtw(a, b, 0.1, 0.5), rel=1e-12)


def frames(spark, truth, pred, **extra):
    n = max(len(truth), len(pred))
    rows = []
    for i in range(n):
        t = truth[i] if i < len(truth) else (None,) * 4
        p = pred[i] if i < len(pred) else (None,) * 4
        rows.append((0, i, *t, *p))
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, x double, y double, z double, a double, px double, py double, pz double, pa double")
    return df.withColumns({"task": F.lit("hl"), "split": F.lit("seen"), "env_id": F.lit("e")} | {k: F.lit(v) for k, v in extra.items()})


def test_a_perfect_prediction(spark):
    path = [(float(i), 0.0, 5.0, 0.0) for i in range(6)]
    r = evaluate.episode_metrics(frames(spark, path, path)).first()
    assert (r.avg_tcr, r.nsp, r.sr, r.spl, r.ndtw) == (1, 1, 1, 1, 1)
    assert math.isnan(r.cr) and math.isnan(r.cspl) and r.num_gt == 6


def test_unequal_lengths_and_a_single_frame(spark):
    r = evaluate.episode_metrics(frames(spark, [(0.0, 0.0, 0.0, 0.0), (10.0, 0.0, 0.0, 0.0)], [(0.0, 0.0, 0.0, 0.0)])).first()
    assert r.num_pred == 1 and r.nsp == 0 and r.gt_length == 10 and math.isnan(r.spl)


def test_collision(spark):
    path = [(0.0, 0.0, 0.0, 0.0), (10.0, 0.0, 0.0, 0.0)]
    wall = spark.createDataFrame([("e", 5.0, -1.0, -1.0, 5.0, 1.0, -1.0, 5.0, 0.0, 2.0)], "env_id string, " + ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz"))
    f = frames(spark, path, path)
    assert evaluate.collisions(f, wall).first().cr == 1
    assert evaluate.collisions(f, wall.withColumns({f"{v}x": F.lit(50.0) for v in "abc"})).first().cr == 0
    assert math.isnan(evaluate.collisions(f, wall.withColumn("env_id", F.lit("other"))).first().cr)


def test_summary_counts_all_and_means_finite(spark):
    df = spark.createDataFrame([("a", "seen", 1.0), ("a", None, float("nan")), ("", "seen", 3.0)], "task string, split string, m double")
    got = {(r.kind, r["name"]): (r.n, r.m) for r in evaluate.summary(df, ["m"]).collect()}
    assert got[("overall", "all")] == (3, 2.0) and got[("task", "unknown")] == (1, 3.0)
    assert got[("split", "unknown")][0] == 1 and math.isnan(got[("split", "unknown")][1])


def test_wrap(spark):
    values = [-10.0, -math.pi, 0.0, math.pi, 3.2, 1000.0]
    df = spark.createDataFrame([(v,) for v in values], "a double").select("a", angles.wrap_rad("a").alias("w"), angles.maybe_deg_to_rad("a").alias("r"))
    for r in df.collect():
        assert r.w == pytest.approx((r.a + math.pi) % (2 * math.pi) - math.pi) and -math.pi <= r.w < math.pi
        assert r.r == (math.radians(r.a) if abs(r.a) > 3.5 * math.pi else r.a)


def test_soft_dtw_of_many_episodes(spark, monkeypatch):
    """Episodes of several lengths, unequal sides, gaps and none, warped together, against the plain recursion."""
    seen, many = [0], evaluate.soft_dtw_many
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for e in range(60):
        n, m = [(5, 5), (5, 3), (1, 4), (0, 3)][e % 4]
        t, p = rng.normal(size=(m, 4)), rng.normal(size=(n, 4))
        if e == 8:
            t[1, 3] = np.nan
        if e == 9:
            p[2, 0] = np.nan
        want[e] = plain_soft_dtw(t[~np.isnan(t).any(1)], p[~np.isnan(p).any(1)], 0.1, 0.5) if n else None
        for i in range(5):
            rows.append((e, i, *(map(float, t[i]) if i < m else [None] * 4), *(map(float, p[i]) if i < n else [None] * 4)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows if isinstance(rows, list) else list(rows), "episode_index long, frame_index long, x double, y double, z double, a double, px double, py double, pz double, pa double")
    got = {r.episode_index: r for r in evaluate.soft_dtw_scores(df).collect()}
    assert set(got) == set(want) and got[8].num_gt == 4 and got[1].num_gt == 3
    for e, v in want.items():
        assert math.isnan(got[e].dtw) if v is None else got[e].dtw == pytest.approx(v, rel=1e-12)
    t, p = rng.normal(size=(200, 50, 4)), rng.normal(size=(200, 40, 4))
    monkeypatch.setattr(evaluate.np, "log", lambda x, f=np.log: (seen.__setitem__(0, seen[0] + 1), f(x))[1])
    many(t, p, 0.1, 0.5)
    assert seen[0] == 89  # one step a diagonal, not one for each episode's


def test_lengths_in_one_shuffle(spark):
    """They are what the single operators give, for a path of one frame, one that ends early and one with gaps."""
    f = frames(spark, [(0.0, 0.0, 0.0, 0.0), (3.0, 4.0, 0.0, 0.0), (3.0, 4.0, 2.0, 0.0)], [(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 0.0)])
    one = frames(spark, [(1.0, 1.0, 1.0, 0.0)], [(1.0, 1.0, 3.0, 0.0)]).withColumn("episode_index", F.lit(1))
    gaps = frames(spark, [(float(i * i), 0.0, 0.0, 0.0) for i in range(6)], [(0.0, float(i), 0.0, 0.0) for i in range(6)]).withColumn("episode_index", F.lit(2)).withColumn("x", F.when(F.col("frame_index") != 2, F.col("x")))
    f = f.withColumn("episode_index", F.lit(0)).unionByName(one).unionByName(gaps)
    want = evaluate.path_length(f, out="gt_length").join(evaluate.path_length(f, cols=evaluate.PXYZ, out="pred_length"), "episode_index").join(evaluate.end_distance(f), "episode_index")
    got = evaluate.lengths(f)
    read = lambda df: sorted(str(tuple(r)) for r in df.select("episode_index", "gt_length", "pred_length", "end_distance").collect())
    assert read(got) == read(want) and got.filter("gt_length = 7").count() == 1
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
