"""Rounding, geometry and small matrix algebra as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofgrid.functions.text import let

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def half_up(x: Column, digits: int = 0) -> Column:
    """Nearest with ties towards plus infinity, at ``digits`` decimals."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low, high) -> Column:
    """Bound ``x`` on both sides; NULL stays NULL."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def add(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def dist3(ax, ay, az, bx, by, bz) -> Column:
    dx, dy, dz = ax - bx, ay - by, az - bz
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    sin_lat, sin_lon = F.sin(dlat / 2), F.sin(dlon / 2)
    h = sin_lat * sin_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sin_lon * sin_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first point to the second, 0..360."""
    dlon = F.radians(lon2 - lon1)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    east = F.sin(dlon) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def angle_gap_deg(a: Column, b: Column) -> Column:
    """Absolute difference of two headings, 0..180."""
    return F.abs((a - b + 540.0) % 360.0 - 180.0)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays, in double precision."""
    products = F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def squared_l2(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda p, q: p.cast("double") - q.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v * v)


def mat4_mul(a: Column, b: Column) -> Column:
    """Product of two row-major 4x4 matrices held as arrays of 16."""
    def product(p):
        return F.array(*[add([p["a"][4 * i + k] * p["b"][4 * k + j] for k in range(4)])
                         for i in range(4) for j in range(4)])

    return let(F.struct(a.alias("a"), b.alias("b")), product)


def mat4_point(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Apply an affine 4x4 matrix to a point."""
    return tuple(m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3] for i in range(3))


def mat3_det(m: Column) -> Column:
    """Determinant of the upper-left 3x3 block of a row-major 4x4 matrix."""
    return (
        m[0] * (m[5] * m[10] - m[6] * m[9])
        - m[1] * (m[4] * m[10] - m[6] * m[8])
        + m[2] * (m[4] * m[9] - m[5] * m[8])
    )


def similarity_scale(m: Column) -> Column:
    """Uniform scale of a similarity transform: cube root of the absolute determinant."""
    return F.cbrt(F.abs(mat3_det(m)))


def similarity_inverse(m: Column) -> Column:
    """Inverse of a scale-rotation-translation 4x4 matrix."""
    def inverse(p):
        m, s2 = p["m"], p["s"] * p["s"]
        rows = []
        for r in range(3):
            line = [m[4 * c + r] / s2 for c in range(3)]
            rows += [*line, -(line[0] * m[3] + line[1] * m[7] + line[2] * m[11])]
        return F.array(*rows, *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])

    return let(F.struct(m.alias("m"), similarity_scale(m).alias("s")), inverse)


def rotate_up(qw, qx, qy, qz, axis: tuple[float, float, float] = (0.0, 1.0, 0.0)):
    """Rotate a fixed axis by a wxyz quaternion."""
    x, y, z = (F.lit(v) for v in axis)
    tx = (qy * z - qz * y) * 2.0
    ty = (qz * x - qx * z) * 2.0
    tz = (qx * y - qy * x) * 2.0
    return (
        x + qw * tx + qy * tz - qz * ty,
        y + qw * ty + qz * tx - qx * tz,
        z + qw * tz + qx * ty - qy * tx,
    )


def quaternion_product(a: tuple, b: tuple) -> tuple:
    """Hamilton product of two wxyz quaternions."""
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    )
