"""Scores of predicted against true trajectories, an episode at a time, and their roll-ups."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytrail.functions import angles
from skytrail.operators.hits import segment_hits

XYZ, PXYZ = ["x", "y", "z"], ["px", "py", "pz"]


def limited(frames: DataFrame, max_len: int = 0, stride: int = 1) -> DataFrame:
    """The first max_len frames of each episode (0: all), then every stride-th."""
    out = frames.filter(F.col("frame_index") < max_len) if max_len > 0 else frames
    return out.filter(F.col("frame_index") % stride == 0) if stride > 1 else out


def path_length(frames: DataFrame, key: str = "episode_index", cols: list[str] = XYZ, out: str = "length") -> DataFrame:
    """Sum of step lengths; NaN for fewer than two frames."""
    w = Window.partitionBy(key).orderBy("frame_index")
    here, before = [F.col(c) for c in cols], [F.lag(c).over(w) for c in cols]
    steps = frames.select(key, angles.distance(here, before).alias("_d"))
    return steps.groupBy(key).agg(F.coalesce(F.sum("_d"), F.lit(math.nan)).alias(out))


def lengths(frames: DataFrame, key: str = "episode_index") -> DataFrame:
    """gt_length, pred_length and end_distance as path_length and end_distance give them, in one shuffle."""
    w = Window.partitionBy(key).orderBy("frame_index")
    step = lambda cols: angles.distance([F.col(c) for c in cols], [F.lag(c).over(w) for c in cols])
    out = frames.select(key, "frame_index", *XYZ, *PXYZ, step(XYZ).alias("_g"), step(PXYZ).alias("_p")).groupBy(key)
    last = [F.max_by(c, "frame_index").alias(f"_last_{c}") for c in XYZ + PXYZ]
    out = out.agg(*[F.coalesce(F.sum(d), F.lit(math.nan)).alias(n) for d, n in (("_g", "gt_length"), ("_p", "pred_length"))], *last)
    return out.select(key, "gt_length", "pred_length", angles.distance([F.col(f"_last_{c}") for c in XYZ], [F.col(f"_last_{c}") for c in PXYZ]).alias("end_distance"))


def nearest(frames: DataFrame, key: str = "episode_index") -> DataFrame:
    """Squared distance of each true frame to the nearest predicted one of its episode.

    The predicted points of an episode travel as one array, so the quadratic part is a loop inside a
    row, never a join that writes all pairs.
    """
    pts = F.sort_array(F.collect_list(F.struct("frame_index", *PXYZ)))
    pred = frames.filter(F.col("px").isNotNull()).groupBy(key).agg(pts.alias("_pts"))
    joined = frames.filter(F.col("x").isNotNull()).select(key, "frame_index", *XYZ).join(pred, key, "left")
    d2 = F.array_min(F.transform("_pts", lambda p: reduce(Column.__add__, [(F.col(c) - p[q]) * (F.col(c) - p[q]) for c, q in zip(XYZ, PXYZ, strict=True)])))
    return joined.select(key, "frame_index", d2.alias("d2"))


def coverage(frames: DataFrame, thresholds: list[float], key: str = "episode_index") -> DataFrame:
    """Share of true frames with a predicted one within each threshold, and the mean of shares."""
    shares = [F.avg((F.col("d2") <= t * t).cast("double")).alias(f"tcr_{i}") for i, t in enumerate(thresholds)]
    out = nearest(frames, key).groupBy(key).agg(*shares)
    return out.withColumn("avg_tcr", reduce(Column.__add__, [F.col(f"tcr_{i}") for i in range(len(thresholds))]) / len(thresholds))


def endpoints(frames: DataFrame, key: str = "episode_index") -> DataFrame:
    """First and last states, true and predicted."""
    first, last = (lambda c: F.min_by(c, "frame_index")), (lambda c: F.max_by(c, "frame_index"))
    return frames.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for f, n in ((first, "first"), (last, "last")) for c in XYZ + PXYZ])


def end_distance(frames: DataFrame, key: str = "episode_index") -> DataFrame:
    e = endpoints(frames, key)
    return e.select(key, angles.distance([F.col(f"last_{c}") for c in XYZ], [F.col(f"last_{c}") for c in PXYZ]).alias("end_distance"))


def progress(frames: DataFrame, key: str = "episode_index") -> DataFrame:
    """How far along the true path the point lies that is nearest to the predicted end, from 0 to 1.

    Zero for a path without length; NaN for fewer than two frames.  The first segment wins ties.
    """
    w = Window.partitionBy(key).orderBy("frame_index")
    end = frames.groupBy(key).agg(*[F.max_by(c, "frame_index").alias(f"e{c}") for c in PXYZ])
    seg = frames.select(key, "frame_index", *XYZ, *[F.lead(c).over(w).alias(f"n{c}") for c in XYZ]).filter("nx is not null")
    seg = seg.withColumn("len", angles.distance([F.col(f"n{c}") for c in XYZ], [F.col(c) for c in XYZ]))
    seg = seg.withColumn("before", F.sum("len").over(w) - F.col("len")).join(end, key)
    dot = reduce(Column.__add__, [(F.col(f"e{q}") - F.col(c)) * (F.col(f"n{c}") - F.col(c)) for c, q in zip(XYZ, PXYZ, strict=True)])
    len2 = F.col("len") * F.col("len")
    seg = seg.withColumn("t", F.when(len2 > 1e-12, F.least(F.greatest(dot / len2, F.lit(0.0)), F.lit(1.0))))
    off = reduce(Column.__add__, [F.pow(F.col(c) + F.col("t") * (F.col(f"n{c}") - F.col(c)) - F.col(f"e{q}"), 2) for c, q in zip(XYZ, PXYZ, strict=True)])
    best = F.min_by(F.col("before") + F.col("t") * F.col("len"), F.when(F.col("t").isNotNull(), F.struct(off.alias("o"), F.col("frame_index").alias("i"))))
    agg = seg.groupBy(key).agg(best.alias("_at"), F.sum("len").alias("_all"))
    value = F.when(F.col("_at").isNull() | (F.col("_all") <= 1e-12), 0.0).otherwise(F.least(F.greatest(F.col("_at") / F.col("_all"), F.lit(0.0)), F.lit(1.0)))
    return frames.select(key).distinct().join(agg, key, "left").select(key, F.when(F.col("_all").isNull(), F.lit(math.nan)).otherwise(value).alias("nsp"))


def soft_dtw(truth: np.ndarray, pred: np.ndarray, yaw_weight: float, gamma: float) -> float:
    """Soft dynamic time warping of two (n, 4) state arrays."""
    return float(soft_dtw_many(truth[None], pred[None], yaw_weight, gamma)[0])


def soft_dtw_many(truth: np.ndarray, pred: np.ndarray, yaw_weight: float, gamma: float) -> np.ndarray:
    """Soft dynamic time warping of pairs of (pairs, n, 4) states, by anti-diagonals of the cost matrix.

    Cell (i, j) needs its left, upper and upper-left neighbours, which lie on the two diagonals
    before, so a whole diagonal of all pairs is one vector operation, and no more than three are held.
    """
    (pairs, n), m = pred.shape[:2], truth.shape[1]
    if not n or not m:
        return np.full(pairs, np.nan)
    # Diagonals are indexed by i, from 0 to n; outside the matrix they are infinite.
    older, old = np.full((pairs, n + 1), np.inf), np.full((pairs, n + 1), np.inf)
    older[:, 0] = 0.0
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1) + 1
        a, b, c = old[:, lo:hi], old[:, lo - 1 : hi - 1], older[:, lo - 1 : hi - 1]
        low = np.minimum(np.minimum(a, b), c)
        base = np.where(np.isfinite(low), low, 0.0)
        soft = base - gamma * np.log(np.exp((base - a) / gamma) + np.exp((base - b) / gamma) + np.exp((base - c) / gamma))
        delta = pred[:, lo - 1 : hi - 1] - truth[:, d - hi : d - lo][:, ::-1]
        delta[..., 3] = yaw_weight * (np.mod(delta[..., 3] + np.pi, 2 * np.pi) - np.pi)
        new = np.full((pairs, n + 1), np.inf)
        new[:, lo:hi] = np.sqrt(np.einsum("bij,bij->bi", delta, delta)) + np.where(np.isfinite(low), soft, np.inf)
        older, old = old, new
    return old[:, n]


DTW_VALUES = 1 << 16  # of a diagonal of the pairs that are warped together


def soft_dtw_scores(frames: DataFrame, yaw_weight: float = 0.1, gamma: float = 0.5, eta: float = 3.0, clip: bool = True, key: str = "episode_index") -> DataFrame:
    """dtw and ndtw of each episode.  The recursion runs in an Arrow kernel, over episodes of equal lengths at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for column in (batch.column(1), batch.column(2)):
                flat = column.flatten()
                values = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xyza"])
                sizes = column.value_lengths().to_numpy()
                paths.append(np.split(values, np.cumsum(sizes)[:-1]))
            shapes: dict[tuple[int, int], list[int]] = {}
            for i, (t, p) in enumerate(zip(*paths, strict=True)):
                shapes.setdefault((len(t), len(p)), []).append(i)
            dtw = np.empty(batch.num_rows)
            for (_, n), alike in shapes.items():
                step = max(1, DTW_VALUES // (n + 1))
                for k in range(0, len(alike), step):
                    part = alike[k : k + step]
                    dtw[part] = soft_dtw_many(*(np.stack([side[i] for i in part]) for side in paths), yaw_weight, gamma)
            num = pa.array([len(t) for t in paths[0]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dtw), num], names=[key, "dtw", "num_gt"])

    def states(cols: list[str], angle: str) -> Column:
        """The states of an episode in order, without those that lack a value."""
        values = [F.col(c).cast("double") for c in cols] + [angles.state_angle(angle)]
        whole = reduce(Column.__and__, [v.isNotNull() & ~F.isnan(v) for v in values])
        return F.array_sort(F.collect_list(F.when(whole, F.struct("frame_index", *[v.alias(c) for v, c in zip(values, "xyza", strict=True)]))))

    frames.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # paths can be long; it stays set, as the query runs later
    out = frames.groupBy(key).agg(states(XYZ, "a").alias("_t"), states(PXYZ, "pa").alias("_p"))
    out = out.mapInArrow(run, f"{key} long, dtw double, num_gt long")
    return out.withColumn("ndtw", angles.ndtw("dtw", "num_gt", eta, clip))


def collisions(frames: DataFrame, triangles: DataFrame, key: str = "episode_index") -> DataFrame:
    """cr of each episode: 1 if a step of the predicted path meets its scene's mesh, 0 if none does,
    NaN if the scene has no mesh; error says so ("no mesh"), else it is null."""
    hits = segment_hits(steps(frames, key), triangles, ["env_id"], [key], nearest=False).select(key, F.lit(1.0).alias("_hit"))
    scenes = triangles.select("env_id").distinct().withColumn("_mesh", F.lit(True))
    eps = frames.groupBy(key).agg(F.min("env_id").alias("env_id")).join(scenes, "env_id", "left").join(hits, key, "left")
    return eps.select(key, F.when(F.col("_mesh").isNull(), F.lit(math.nan)).otherwise(F.coalesce("_hit", F.lit(0.0))).alias("cr"), F.when(F.col("_mesh").isNull(), "no mesh").alias("error"))


def steps(frames: DataFrame, key: str = "episode_index") -> DataFrame:
    """The segments (p0*, p1*) of the predicted path, each under its first frame's index."""
    w = Window.partitionBy(key).orderBy("frame_index")
    pairs = list(zip("xyz", PXYZ, strict=True))
    return frames.select(key, "frame_index", "env_id", *[F.col(q).alias(f"p0{c}") for c, q in pairs], *[F.lead(q).over(w).alias(f"p1{c}") for c, q in pairs]).filter("p1x is not null")


def path_scores(frames: DataFrame, thresholds: list[float], key: str = "episode_index") -> DataFrame:
    """The scores of both paths in one shuffle: an episode's points travel as two sorted arrays.

    num_gt, num_pred, gt_length, pred_length, tcr_i, avg_tcr, end_distance and nsp as the operators
    path_length, coverage, end_distance and progress give them.
    """
    point = lambda cols: F.struct("frame_index", *[F.col(c).cast("double").alias(k) for c, k in zip(cols, "xyz", strict=True)])
    gather = lambda cols, name: F.array_sort(F.collect_list(F.when(F.col(cols[0]).isNotNull(), point(cols)))).alias(name)
    last = [F.max_by(c, "frame_index").alias(f"_last_{c}") for c in XYZ + PXYZ]
    kept = [F.min(c).alias(c) for c in ("task", "split", "env_id") if c in frames.columns]
    e = frames.groupBy(key).agg(gather(XYZ, "_g"), gather(PXYZ, "_p"), F.count("*").alias("_rows"), *last, *kept)
    square = lambda a, b: reduce(Column.__add__, [(a[c] - b[c]) * (a[c] - b[c]) for c in "xyz"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n = {k: F.size(k) for k in ("_g", "_p")}
    lengths = lambda k: F.when(n[k] > 1, F.zip_with(F.slice(k, 1, n[k] - 1), F.slice(k, 2, n[k] - 1), lambda a, b: F.sqrt(square(a, b)))).otherwise(F.array().cast("array<double>"))
    e = e.withColumns({"_gl": lengths("_g"), "_pl": lengths("_p"), "_d2": F.transform("_g", lambda a: F.array_min(F.transform("_p", lambda b: square(a, b))))})
    # The true path's segments: where each begins, its length, and the spot nearest to the predicted end.
    end = F.struct(*[F.col(f"_last_{q}").alias(c) for c, q in zip("xyz", PXYZ, strict=True)])
    e = e.withColumn("_end", end).withColumn("_before", F.aggregate("_gl", F.array(F.lit(0.0)), lambda s, v: F.array_append(s, F.element_at(s, -1) + v)))

    def spot(v: Column, i: Column) -> Column:
        a, b = F.get("_g", i), F.get("_g", i + 1)
        dot = reduce(Column.__add__, [(F.col("_end")[c] - a[c]) * (b[c] - a[c]) for c in "xyz"])
        t = F.least(F.greatest(dot / (v * v), F.lit(0.0)), F.lit(1.0))
        off = reduce(Column.__add__, [F.pow(a[c] + t * (b[c] - a[c]) - F.col("_end")[c], 2) for c in "xyz"])
        return F.when(v * v > 1e-12, F.struct(off.alias("off"), i.alias("i"), (F.get("_before", i) + t * v).alias("at")))

    best = F.array_min(F.array_compact(F.transform("_gl", spot)))["at"]
    whole = F.element_at("_before", -1)
    nsp = F.when(n["_g"] < 2, F.lit(math.nan)).when(best.isNull() | (whole <= 1e-12), 0.0).otherwise(F.least(F.greatest(best / whole, F.lit(0.0)), F.lit(1.0)))
    within = lambda t: F.size(F.filter("_d2", lambda v: v <= t * t))
    hits = [F.when(n["_g"] > 0, within(t).cast("double") / n["_g"]) for t in thresholds]
    out = e.select(
        key,
        *[c for c in ("task", "split", "env_id") if c in frames.columns],
        n["_g"].cast("long").alias("num_gt"),
        n["_p"].cast("long").alias("num_pred"),
        *[h.alias(f"tcr_{i}") for i, h in enumerate(hits)],
        nsp.alias("nsp"),
        angles.distance([F.col(f"_last_{c}") for c in XYZ], [F.col(f"_last_{c}") for c in PXYZ]).alias("end_distance"),
        F.when(n["_g"] > 1, total("_gl")).otherwise(math.nan).alias("gt_length"),
        F.when(n["_p"] > 1, total("_pl")).otherwise(math.nan).alias("pred_length"),
    )
    return out.withColumn("avg_tcr", reduce(Column.__add__, [F.col(f"tcr_{i}") for i in range(len(thresholds))]) / len(thresholds))


METRICS = ["avg_tcr", "ndtw", "nsp", "sr", "cr", "spl", "cspl"]


def episode_metrics(frames: DataFrame, thresholds: list[float] = (1.0, 2.0, 5.0), radius: float = 20.0, eta: float = 3.0, yaw_weight: float = 0.1, gamma: float = 0.5, triangles: DataFrame | None = None, max_len: int = 0, stride: int = 1) -> DataFrame:
    """One record an episode with all scores.  frames: task, split, env_id, episode_index,
    frame_index, true x, y, z, a and predicted px, py, pz, pa (null beyond the end of either)."""
    f = limited(frames, max_len, stride)
    out = path_scores(f, list(thresholds)).join(soft_dtw_scores(f, yaw_weight, gamma, eta).drop("num_gt"), "episode_index", "left")
    out = out.join(collisions(f, triangles), "episode_index", "left") if triangles is not None else out.withColumns({"cr": F.lit(math.nan), "error": F.lit("no mesh")})
    out = out.withColumn("sr", angles.success("end_distance", radius))
    return out.withColumns({"spl": angles.spl("sr", "gt_length", "pred_length"), "cspl": angles.spl("sr", "gt_length", "pred_length", "cr")})


def summary(records: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Means of finite values, and counts of all records: overall, by split and by task, in one pass."""
    keys = records.withColumns({k: F.when(F.coalesce(F.col(k), F.lit("")) == "", "unknown").otherwise(F.col(k)) for k in ("split", "task")})
    rolled = keys.groupingSets([[], ["split"], ["task"]], "split", "task").agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), *[angles.finite_mean(m).alias(m) for m in metrics])
    kind = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "split").otherwise("task")
    return rolled.select(kind.alias("kind"), F.coalesce("split", "task", F.lit("all")).alias("name"), "n", *metrics)


def running_means(records: DataFrame, cols: list[str], order: str) -> DataFrame:
    """Means so far, over records that come in order (a table of episodes, not of frames)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return records.select(order, *[F.avg(c).over(w).alias(f"mean_{c}") for c in cols])
