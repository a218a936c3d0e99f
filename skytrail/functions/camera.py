"""Camera orientations and projections, and geodetic coordinates, as closed-form columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the WGS84 ellipsoid and of the UTM projection.
A = 6378137.0
FLAT = 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
UTM_SCALE = 0.9996
UTM_EAST = 500000.0


def rotation(omega: Column, phi: Column, kappa: Column) -> list[list[Column]]:
    """Rz(kappa) Ry(phi) Rx(omega), angles in radians, as a 3 x 3 list of columns."""
    so, co, sp, cp, sk, ck = F.sin(omega), F.cos(omega), F.sin(phi), F.cos(phi), F.sin(kappa), F.cos(kappa)
    return [
        [ck * cp, ck * sp * so - sk * co, ck * sp * co + sk * so],
        [sk * cp, sk * sp * so + ck * co, sk * sp * co - ck * so],
        [-sp, cp * so, cp * co],
    ]


def world_to_camera(omega: Column, phi: Column, kappa: Column) -> list[list[Column]]:
    """The product of the three inverse turns, as poses are recorded."""
    so, co, sp, cp, sk, ck = F.sin(omega), F.cos(omega), F.sin(phi), F.cos(phi), F.sin(kappa), F.cos(kappa)
    top, mid = [cp, sp * so, -sp * co], [F.lit(0.0), co, so]
    return [[ck * a + sk * b for a, b in zip(top, mid, strict=True)], [ck * b - sk * a for a, b in zip(top, mid, strict=True)], [sp, -cp * so, cp * co]]


def angles_of(r: list[list[Column]]) -> tuple[Column, Column, Column]:
    """(omega, phi, kappa) of a world_to_camera rotation; where phi is a right angle, omega is zero."""
    phi = F.asin(F.least(F.greatest(r[2][0], F.lit(-1.0)), F.lit(1.0)))
    level = F.abs(F.cos(phi)) >= 1e-8
    omega = F.when(level, F.atan2(-r[2][1], r[2][2])).otherwise(F.lit(0.0))
    return omega, phi, F.when(level, F.atan2(-r[1][0], r[0][0])).otherwise(F.atan2(-r[1][2], r[1][1]))


def nadir_rotation(dx: Column, dy: Column) -> list[list[Column]]:
    """World to camera, looking straight down with the image's top towards (dx, dy)."""
    n = F.sqrt(dx * dx + dy * dy)
    x, y = dx / n, dy / n
    zero, one = F.lit(0.0), F.lit(1.0)
    return [[y, -x, zero], [-x, -y, zero], [zero, zero, -one]]


def level_angles(dx: Column, dy: Column) -> tuple[Column, Column, Column]:
    """Degrees (omega, phi, kappa) of a level camera that looks towards (dx, dy)."""
    heading = F.degrees(F.atan2(dx, dy))
    return F.lit(-90.0), F.pmod(heading + 180.0, F.lit(360.0)) - 180.0, F.lit(0.0)


def project(r: list[list[Column]], centre: list[Column], point: list[Column], fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """Pixel (u, v) and depth of a world point; a depth of zero counts as a tiny one."""
    d = [p - c for p, c in zip(point, centre, strict=True)]
    x, y, z = (sum((a * b for a, b in zip(row, d, strict=True)), F.lit(0.0)) for row in r)
    z_ = F.when(F.abs(z) < 1e-12, 1e-12).otherwise(z)
    return fx * x / z_ + cx, fy * y / z_ + cy, z


def field_of_view(size: Column, focal: Column) -> Column:
    return 2.0 * F.atan(0.5 * size / focal)


def focal_length(size: Column, fov: Column) -> Column:
    return 0.5 * size / F.tan(0.5 * fov)


def ecef(lat: Column, lon: Column, h: Column) -> list[Column]:
    """Degrees and metres to earth-centred coordinates."""
    la, lo = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(la) * F.sin(la))
    return [(n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1 - E2) + h) * F.sin(la)]


def enu_to_ecef(e: Column, n: Column, u: Column, lat: Column, lon: Column, h: Column) -> list[Column]:
    """East, north, up from an origin to earth-centred coordinates."""
    la, lo = F.radians(lat), F.radians(lon)
    o = ecef(lat, lon, h)
    return [
        o[0] - F.sin(lo) * e - F.sin(la) * F.cos(lo) * n + F.cos(la) * F.cos(lo) * u,
        o[1] + F.cos(lo) * e - F.sin(la) * F.sin(lo) * n + F.cos(la) * F.sin(lo) * u,
        o[2] + F.cos(la) * n + F.sin(la) * u,
    ]


def geodetic(x: Column, y: Column, z: Column) -> list[Column]:
    """Latitude, longitude (degrees) and height by Bowring's formula, iterated once more."""
    b = A * (1 - FLAT)
    ep2 = (A * A - b * b) / (b * b)
    p = F.sqrt(x * x + y * y)
    beta = F.atan2(A * z, b * p)
    for _ in range(2):
        lat = F.atan2(z + ep2 * b * F.pow(F.sin(beta), 3), p - E2 * A * F.pow(F.cos(beta), 3))
        beta = F.atan2((1 - FLAT) * F.sin(lat), F.cos(lat))
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    h = p * F.cos(lat) + z * F.sin(lat) - A * A / n
    return [F.degrees(lat), F.degrees(F.atan2(y, x)), h]


def utm(lat: Column, lon: Column, zone: int, south: bool = False) -> list[Column]:
    """Easting and northing by Krüger's series to the third order."""
    n = FLAT / (2 - FLAT)
    a1, a2, a3 = n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    la, dl = F.radians(lat), F.radians(lon) - math.radians(zone * 6 - 183)
    k = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(la)
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate((a1, a2, a3), 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return [UTM_EAST + UTM_SCALE * radius * east, (1e7 if south else 0.0) + UTM_SCALE * radius * north]


Matrix = list[list[Column]]


def projection_matrix(near: float, far: float, fov_x: Column, fov_y: Column) -> Matrix:
    """A symmetric perspective: x and y by their fields of view, depth from 0 at `near` to 1 at `far`."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return [[1 / F.tan(fov_x / 2), zero, zero, zero], [zero, 1 / F.tan(fov_y / 2), zero, zero], [zero, zero, F.lit(far / (far - near)), F.lit(-far * near / (far - near))], [zero, zero, one, zero]]


def view_matrix(camera_to_world: Matrix, translation: list[Column]) -> Matrix:
    """World to view: the transpose of the camera's rotation, then the translation."""
    rows = [[camera_to_world[j][i] for j in range(3)] + [translation[i]] for i in range(3)]
    return [*rows, [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]]


def matrix_product(a: Matrix, b: Matrix) -> Matrix:
    return [[sum((a[i][k] * b[k][j] for k in range(4)), F.lit(0.0)) for j in range(4)] for i in range(4)]


def transformed(m: Matrix, point: list[Column], tiny: float = 1e-7) -> list[Column]:
    """A point through a 4 x 4 matrix, divided by its last coordinate plus a tiny number."""
    p = [*point, F.lit(1.0)]
    out = [sum((a * b for a, b in zip(row, p, strict=True)), F.lit(0.0)) for row in m]
    return [v / (out[3] + tiny) for v in out[:3]]
