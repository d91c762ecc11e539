"""Rotations as column expressions. Quaternions are Hamilton, scalar first, body to local; angles in radians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Quaternion = tuple[Column, Column, Column, Column]


def normalized(q: Quaternion) -> Quaternion:
    n = F.sqrt(sum((x * x for x in q[1:]), q[0] * q[0]))
    return tuple(x / n for x in q)


def multiply(a: Quaternion, b: Quaternion) -> Quaternion:
    return (
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    )


def conjugate(q: Quaternion) -> Quaternion:
    return q[0], -q[1], -q[2], -q[3]


def from_rpy(roll: Column, pitch: Column, yaw: Column) -> Quaternion:
    half = lambda axis, a: tuple([F.cos(a / 2), *(F.sin(a / 2) if k == axis else F.lit(0.0) for k in range(3))])
    return multiply(multiply(half(2, yaw), half(1, pitch)), half(0, roll))


def to_matrix(q: Quaternion) -> list[list[Column]]:
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def to_rpy(q: Quaternion) -> Vector:
    r = to_matrix(q)
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -r[2][0]))
    free = F.abs(s) < 0.9999
    return F.when(free, F.atan2(r[2][1], r[2][2])).otherwise(F.atan2(-r[1][2], r[1][1])), F.asin(s), F.when(free, F.atan2(r[1][0], r[0][0])).otherwise(0.0)


def from_rotation_vector(v: Vector) -> Quaternion:
    a = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    k = F.when(a > 1e-9, F.sin(a / 2) / a).otherwise(0.5)
    return F.cos(a / 2), v[0] * k, v[1] * k, v[2] * k


def integrated(q: Quaternion, rate: Vector, dt: Column) -> Quaternion:
    """Attitude after dt at a body rate."""
    return normalized(multiply(q, from_rotation_vector(tuple(x * dt for x in rate))))


def axis_angle(q: Quaternion) -> tuple[Vector, Column]:
    n = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    axis = tuple(F.when(n > 1e-9, x / n).otherwise(1.0 if k == 0 else 0.0) for k, x in enumerate(q[1:]))
    return axis, 2 * F.atan2(n, q[0])


def rotate(m: list[list[Column]], v: Vector) -> Vector:
    return tuple(r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in m)


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def angle_diff(a: Column, b: Column) -> Column:
    return F.atan2(F.sin(a - b), F.cos(a - b))


def levelled(acc: Vector) -> tuple[Column, Column]:
    """Roll and pitch from specific force at rest."""
    return F.atan2(-acc[1], -acc[2]), F.atan2(acc[0], F.sqrt(acc[1] * acc[1] + acc[2] * acc[2]))


def magnetic_heading(mag: Vector, roll: Column, pitch: Column) -> Column:
    """Tilt-compensated heading, from magnetic north."""
    across = mag[1] * F.cos(roll) - mag[2] * F.sin(roll)
    down = mag[1] * F.sin(roll) + mag[2] * F.cos(roll)
    return F.atan2(-across, mag[0] * F.cos(pitch) + down * F.sin(pitch))


def baseline_yaw(heading: Column, roll: Column, pitch: Column, baseline: Vector) -> Column:
    """Yaw from the azimuth of a body-fixed baseline; null where under a tenth of it is horizontal."""
    cp, sp, cr, sr = F.cos(pitch), F.sin(pitch), F.cos(roll), F.sin(roll)
    ahead = cp * baseline[0] + sp * (sr * baseline[1] + cr * baseline[2])
    right = cr * baseline[1] - sr * baseline[2]
    whole = F.sqrt(sum((b * b for b in baseline[1:]), baseline[0] * baseline[0]))
    return F.when(F.sqrt(ahead * ahead + right * right) >= 0.1 * whole, angle_diff(heading, F.atan2(right, ahead)))


def from_matrix(r: list[list[Column]]) -> Quaternion:
    """The quaternion of a rotation matrix, from the largest of its four squares; its sign makes that part positive."""
    squares = [1 + r[0][0] + r[1][1] + r[2][2], 1 + r[0][0] - r[1][1] - r[2][2], 1 - r[0][0] + r[1][1] - r[2][2], 1 - r[0][0] - r[1][1] + r[2][2]]  # 4 times each
    both = {(0, 1): r[2][1] - r[1][2], (0, 2): r[0][2] - r[2][0], (0, 3): r[1][0] - r[0][1], (1, 2): r[0][1] + r[1][0], (1, 3): r[0][2] + r[2][0], (2, 3): r[1][2] + r[2][1]}
    forms = [[squares[k] / (2 * F.sqrt(squares[k])) if i == k else both[min(i, k), max(i, k)] / (2 * F.sqrt(squares[k])) for i in range(4)] for k in range(4)]
    pivot = [(squares[0] > 1), (r[0][0] > r[1][1]) & (r[0][0] > r[2][2]), r[1][1] > r[2][2]]
    return tuple(F.when(pivot[0], forms[0][i]).when(pivot[1], forms[1][i]).when(pivot[2], forms[2][i]).otherwise(forms[3][i]) for i in range(4))


def rotation_vector(q: Quaternion) -> Vector:
    """The rotation vector of a quaternion, of at most half a turn."""
    s = F.when(q[0] < 0, -1.0).otherwise(1.0)
    n = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    k = F.when(n > 1e-12, 2 * F.atan2(n, s * q[0]) / n).otherwise(2.0) * s
    return q[1] * k, q[2] * k, q[3] * k


def turned(m: list[list[Column]], v: Vector) -> Vector:
    return tuple(m[i][0] * v[0] + m[i][1] * v[1] + m[i][2] * v[2] for i in range(3))


def within(v: Vector, most: float) -> Column:
    """Whether all parts are at most `most` in magnitude; null and NaN are not."""
    return F.coalesce(F.greatest(*(F.when(F.isnan(x), float("inf")).otherwise(F.abs(x)) for x in v)) <= most, F.lit(False)) & v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull()
