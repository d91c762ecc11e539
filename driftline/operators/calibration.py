"""Calibration: sums over samples on the executors, small solves on the driver."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, terms: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """n and the sums of products of all pairs of terms, as a_b: what a least squares fit needs of the rows."""
    names = list(terms)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = [F.sum(terms[a] * terms[b]).alias(f"{a}_{b}") for a, b in pairs]
    return (df.groupBy(*by) if by else df.groupBy()).agg(F.count(F.lit(1)).alias("n"), *sums)


def matrix(row, names: list[str]) -> np.ndarray:
    return np.array([[row[f"{a}_{b}" if i <= j else f"{b}_{a}"] for j, b in enumerate(names)] for i, a in enumerate(names)], float)


def ellipsoid(df: DataFrame, x: str, y: str, z: str, radius: float = 1.0, rounds: int = 3, reject: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """M and b so that |M (v - b)| is `radius`: the quadric of the least eigenvalue, refitted without outliers.

    Rows are centred and scaled first; only sums of products come to the driver.
    """
    s = df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate((x, y, z)) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    centre, scale = np.array([s[f"m{i}"] for i in range(3)]), max(s[f"s{i}"] for i in range(3)) or 1.0
    u = [(F.col(c) - float(centre[i])) / float(scale) for i, c in enumerate((x, y, z))]
    terms = {"xx": u[0] * u[0], "yy": u[1] * u[1], "zz": u[2] * u[2], "xy": 2 * u[0] * u[1], "xz": 2 * u[0] * u[2], "yz": 2 * u[1] * u[2], "x": 2 * u[0], "y": 2 * u[1], "z": 2 * u[2], "o": F.lit(1.0)}
    rows, out = df, None
    for _ in range(rounds):
        values, vectors = np.linalg.eigh(matrix(gram(rows, terms).first(), list(terms)))
        q = vectors[:, 0] * np.sign(vectors[:3, 0].sum() or 1.0)
        a = np.array([[q[0], q[3], q[4]], [q[3], q[1], q[5]], [q[4], q[5], q[2]]])
        b = -np.linalg.solve(a, q[6:9])
        w, v = np.linalg.eigh(a / (b @ a @ b - q[9]))
        root = v @ np.diag(np.sqrt(np.maximum(w, 1e-12))) @ v.T
        out = root / scale * radius, centre + scale * b
        m, c = out
        off = [sum((float(m[i, k]) * (F.col(n) - float(c[k])) for k, n in enumerate((x, y, z))), F.lit(0.0)) for i in range(3)]
        far = F.abs(F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]) / radius - 1)
        mad = df.agg(F.median(far).alias("m")).first()["m"] * 1.4826
        rows = df.where(far <= reject * max(mad, 1e-12))
    return out


def wahba(df: DataFrame, measured: tuple[str, str, str], ideal: tuple[str, str, str], weight: Column | None = None) -> np.ndarray:
    """The rotation that best takes the directions of measured vectors to those of ideal ones; lengths do not count."""
    norm = lambda v: F.sqrt(sum((F.col(c) * F.col(c) for c in v), F.lit(0.0)))
    w = (F.lit(1.0) if weight is None else weight) / (norm(measured) * norm(ideal))
    s = df.agg(*(F.sum(w * F.col(a) * F.col(b)).alias(f"{i}{j}") for i, b in enumerate(ideal) for j, a in enumerate(measured))).first()
    u, _, vt = np.linalg.svd(np.array([[s[f"{i}{j}"] for j in range(3)] for i in range(3)]))
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt


def shortest_rotation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest rotation that takes direction a to direction b."""
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    v, c = np.cross(a, b), float(a @ b)
    if c < -1 + 1e-12:
        axis = np.cross(a, np.eye(3)[np.argmin(np.abs(a))])
        axis /= np.linalg.norm(axis)
        return 2 * np.outer(axis, axis) - np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + k + k @ k / (1 + c)


def levenberg(fun, x0: np.ndarray, rounds: int = 200, tolerance: float = 1e-12, free: Iterable[int] | None = None) -> tuple[np.ndarray, float]:
    """Least squares of fun's residuals by damped Gauss-Newton with forward differences; parameters that are not free stay."""
    x, damp = np.asarray(x0, float), 1e-3
    if free is not None:
        own, whole = list(free), x.copy()

        def placed(part: np.ndarray) -> np.ndarray:
            out = whole.copy()
            out[own] = part
            return out

        part, cost = levenberg(lambda part: fun(placed(part)), x[own], rounds, tolerance)
        return placed(part), cost
    r = fun(x)
    for _ in range(rounds):
        jac = np.stack([(fun(x + np.eye(len(x))[k] * (h := 1e-7 * max(1.0, abs(x[k])))) - r) / h for k in range(len(x))], 1)
        normal, grad = jac.T @ jac, jac.T @ r
        step = np.linalg.solve(normal + damp * np.diag(np.maximum(np.diag(normal), 1e-12)), -grad)
        new = fun(x + step)
        if new @ new < r @ r:
            done = r @ r - new @ new < tolerance * (r @ r) or np.abs(step).max() < tolerance
            x, r, damp = x + step, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return x, float(r @ r)


def calibrated(v: tuple[Column, Column, Column], m: np.ndarray, b: np.ndarray) -> tuple[Column, Column, Column]:
    """M (v - b); an all-zero M is the identity."""
    m = np.eye(3) if not np.any(m) else m
    return tuple(sum((float(m[i, k]) * (v[k] - float(b[k])) for k in range(3)), F.lit(0.0)) for i in range(3))
