"""Angles, states and scores as column expressions (doubles inside, floats only at the edges)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
DEGREES_FROM = 3.5 * math.pi  # larger magnitudes are taken as degrees


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wrap_rad(a: Column | str) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(_col(a) + math.pi, F.lit(TWO_PI)) - math.pi


def wrap_deg(a: Column | str) -> Column:
    """Into [-180, 180)."""
    return F.pmod(_col(a) + 180.0, F.lit(360.0)) - 180.0


def maybe_deg_to_rad(a: Column | str) -> Column:
    a = _col(a).cast("double")
    return F.when(F.abs(a) > DEGREES_FROM, F.radians(a)).otherwise(a)


def state_angle(a: Column | str) -> Column:
    """The angle of a recorded state: degrees are recognised, the result is wrapped."""
    return wrap_rad(maybe_deg_to_rad(a))


def pose_angle(task: Column | str, phi: Column | str, kappa: Column | str) -> Column:
    """The one angle of a pose in radians: phi for obstacle tasks, else kappa (both in degrees)."""
    name = F.lower(F.trim(_col(task)))
    return F.radians(wrap_deg(F.when(name.isin("obstacle", "task_obstacle"), _col(phi)).otherwise(_col(kappa))))


def legacy_yaw(a: Column | str) -> Column:
    return wrap_rad(math.pi / 2 - _col(a))


def float32(x: Column | str) -> Column:
    return _col(x).cast("float").cast("double")


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def point_cost(a: list[Column], b: list[Column], yaw_weight: float = 0.1) -> Column:
    """Distance of two states (x, y, z, angle), the angle weighted."""
    da = wrap_rad(a[3] - b[3])
    squares = sum(((x - y) * (x - y) for x, y in zip(a[:3], b[:3], strict=True)), F.lit(0.0))
    return F.sqrt(squares + yaw_weight * yaw_weight * da * da)


def softmin3(a: Column, b: Column, c: Column, gamma: float) -> Column:
    m = F.least(a, b, c)
    return m - gamma * F.log(F.exp((m - a) / gamma) + F.exp((m - b) / gamma) + F.exp((m - c) / gamma))


def finite(x: Column | str) -> Column:
    """x, or null where it is null, NaN or infinite."""
    x = _col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)


def finite_mean(x: Column | str) -> Column:
    """Mean of the finite values, NaN without any."""
    return F.coalesce(F.avg(finite(x)), F.lit(math.nan))


def success(end_distance: Column | str, radius: float = 20.0) -> Column:
    d = _col(end_distance)
    return F.when(d.isNull(), F.lit(math.nan)).when(d <= radius, 1.0).otherwise(0.0)


def ndtw(dtw: Column | str, n_truth: Column | str, eta: float = 3.0, clip: bool = True) -> Column:
    score = F.exp(-finite(dtw) / F.greatest(eta * _col(n_truth).cast("double"), F.lit(1e-6)))
    score = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) if clip else score
    return F.coalesce(score, F.lit(math.nan))


def spl(sr: Column | str, truth: Column | str, pred: Column | str, collided: Column | str | None = None) -> Column:
    """Success by path efficiency; with collided also by freedom of collision.  NaN if any is not finite."""
    g, p = finite(truth), finite(pred)
    ratio = F.when(g.isNotNull() & p.isNotNull() & (g > 1e-12), g / F.greatest(g, p))
    out = finite(sr) * ratio
    if collided is not None:
        out = out * (1.0 - finite(collided))
    return F.coalesce(out, F.lit(math.nan))
