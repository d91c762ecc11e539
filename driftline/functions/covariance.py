"""Covariances of three axes as six columns nn, ne, nd, ee, ed, dd."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.geo import signed_root

Cov = tuple[Column, Column, Column, Column, Column, Column]


def valid(c: Cov) -> Column:
    """Whether the diagonal is finite and positive."""
    ok = [~F.isnan(x) & (x > 0) & (x < float("inf")) for x in (c[0], c[3], c[5])]
    return F.coalesce(ok[0] & ok[1] & ok[2], F.lit(False))


def within(c: Cov, horizontal: float | None, vertical: float | None) -> Column:
    """Whether each axis's sigma is inside its limit (None: no limit); a diagonal that is not positive never is."""
    out = valid(c)
    if horizontal is not None:
        out = out & (c[0] <= horizontal * horizontal) & (c[3] <= horizontal * horizontal)
    return out & (c[5] <= vertical * vertical) if vertical is not None else out


def rows_of(c: Cov) -> list[list[Column]]:
    """The symmetric matrix as rows."""
    nn, ne, nd, ee, ed, dd = c
    return [[nn, ne, nd], [ne, ee, ed], [nd, ed, dd]]


def conditioned(c: Cov, scale: float = 1.0, down_scale: float = 1.0, floor: float = 0.0, cap: float | None = None) -> Cov:
    """Scaled sigmas (down once more), diagonals that are positive raised to floor², and axes capped by congruence."""
    s = scale * scale
    nn, ne, nd, ee, ed, dd = (c[0] * s, c[1] * s, c[2] * s * down_scale, c[3] * s, c[4] * s * down_scale, c[5] * s * down_scale * down_scale)
    raised = lambda x: F.when(x > 0, F.greatest(x, F.lit(floor * floor))).otherwise(x)
    nn, ee, dd = raised(nn), raised(ee), raised(dd)
    if cap is None:
        return nn, ne, nd, ee, ed, dd
    k = [F.when(F.sqrt(x) > cap, cap / F.sqrt(x)).otherwise(1.0) for x in (nn, ee, dd)]
    return nn * k[0] * k[0], ne * k[0] * k[1], nd * k[0] * k[2], ee * k[1] * k[1], ed * k[1] * k[2], dd * k[2] * k[2]


def with_fallback(c: Cov, horizontal: float, vertical: float) -> Cov:
    """Diagonals that are not positive replaced; null where they still are not."""
    put = lambda x, v: F.when(x > 0, x).otherwise(F.lit(v) if v > 0 else F.lit(None).cast("double"))
    return put(c[0], horizontal), c[1], c[2], put(c[3], horizontal), c[4], put(c[5], vertical)


def enu_roots(c: Cov) -> tuple[Column, ...]:
    """sd east, north, up, and signed roots of east-north, north-up, up-east."""
    return F.sqrt(c[3]), F.sqrt(c[0]), F.sqrt(c[5]), signed_root(c[1]), signed_root(-c[2]), signed_root(-c[4])


def chi2_rejected(innovation: Column, variance: Column, threshold: float) -> Column:
    """Whether a squared innovation is over threshold times its variance; 0 tests nothing."""
    return (innovation * innovation > threshold * variance) if threshold > 0 else F.lit(False)
