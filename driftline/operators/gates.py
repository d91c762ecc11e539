"""Gates, reason codes and findings as case expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import covariance
from driftline.functions.covariance import Cov


def finite(*xs: Column) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return out


def heading_reason(carrier: Column, sigma_deg: Column, horizontal: Column, fixed_only: bool = True, max_sigma_deg: float = 10.0) -> Column:
    """Why a dual-antenna heading is not used: carrier, sigma, geometry; null if it is."""
    need = carrier == 2 if fixed_only else carrier >= 1
    return F.when(~F.coalesce(need, F.lit(False)), "carrier").when(~(finite(sigma_deg) & (sigma_deg > 0) & (sigma_deg <= max_sigma_deg)), "sigma").when(~F.coalesce(horizontal >= 0.1, F.lit(False)), "geometry")


def mode(ins_ready: Column, attitude_ready: Column, aided_age_ms: Column, fresh_ms: int = 2000) -> Column:
    """3 full, 2 coasting, 1 attitude only, 0 none."""
    fresh = F.coalesce(aided_age_ms <= fresh_ms, F.lit(False))
    return F.when(ins_ready & fresh, 3).when(ins_ready, 2).when(attitude_ready, 1).otherwise(0)


def fix_quality(fix_type: Column, ok: Column, differential: Column, carrier: Column) -> Column:
    """Solution status: 1 fixed, 2 float, 4 differential, 5 single, 0 none."""
    return F.when(~F.coalesce(ok & fix_type.isin(2, 3, 4), F.lit(False)), 0).when(carrier == 2, 1).when(carrier == 1, 2).when(differential, 4).otherwise(5)


def usable(is_valid: Column, c: Cov, horizontal: float, vertical: float) -> Column:
    """Whether a position or velocity may be fused: valid, and each axis's sigma within its limit."""
    return F.coalesce(is_valid, F.lit(False)) & covariance.within(c, horizontal, vertical)


def entry_quality(pos_valid: Column, pos: Cov, vel_valid: Column, vel: Cov, limits: tuple[float, float, float, float], local: Column | None = None, baro_height: bool = False) -> Column:
    """Whether an epoch counts towards the full solution: a position within its limits, and the velocity where there is one.

    limits: horizontal and vertical position, horizontal and vertical velocity. baro_height: the vertical position limit
    does not hold. A local position counts by itself.
    """
    h, v, vh, vv = limits
    ok = usable(pos_valid, pos, h, float("inf") if baro_height else v) & (~F.coalesce(vel_valid, F.lit(False)) | covariance.within(vel, vh, vv))
    return ok if local is None else F.coalesce(local, F.lit(False)) | ok


def stay_quality(pos_valid: Column, pos: Cov, vel_valid: Column, vel: Cov, limits: tuple[float, float, float, float], local: Column | None = None, baro_height: bool = False) -> Column:
    """Whether an epoch is good enough to stay: all that it offers is within the limits."""
    h, v, vh, vv = limits
    off = lambda is_valid: ~F.coalesce(is_valid, F.lit(False))
    ok = (off(pos_valid) | covariance.within(pos, h, float("inf") if baro_height else v)) & (off(vel_valid) | covariance.within(vel, vh, vv))
    return ok if local is None else F.coalesce(local, F.lit(False)) | ok


def lever_arms(gnss: list[Column], score: list[Column], tolerance: float = 0.01) -> Column:
    """none, same, score_unset, gnss_unset or differ."""
    zero = lambda v: (v[0] == 0) & (v[1] == 0) & (v[2] == 0)
    near = F.greatest(*(F.abs(a - b) for a, b in zip(gnss, score, strict=True))) <= tolerance
    return F.when(zero(gnss) & zero(score), "none").when(zero(score), "score_unset").when(zero(gnss), "gnss_unset").when(near, "same").otherwise("differ")


def findings(metrics: DataFrame, by: list[str], rules: list[tuple[str, int, Column]]) -> DataFrame:
    """by, rule, severity: a row for each rule whose condition holds. rules: (name, severity, condition)."""
    each = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, c in rules))
    return metrics.select(*by, F.explode(F.array_compact(each)).alias("f")).select(*by, "f.rule", "f.severity")


def coasting_growth(position_noise: float, velocity_noise: float, acc_noise: float, horizon_s: float) -> tuple[float, float]:
    """Sigmas of position and velocity after a horizon without aiding, from white noise densities of each stage."""
    v = velocity_noise * horizon_s + acc_noise * horizon_s
    p = position_noise * horizon_s + (velocity_noise + acc_noise) * horizon_s**3 / 3
    return p**0.5, v**0.5


def growth_columns(acc_psd: Column, walk_psd: Column, horizon: Column) -> tuple[Column, Column]:
    """The same for acceleration noise and a bias that walks, as columns: integrated white noise of order 1 to 3."""
    return F.sqrt(acc_psd * F.pow(horizon, 3) / 3 + walk_psd * F.pow(horizon, 5) / 20), F.sqrt(acc_psd * horizon + walk_psd * F.pow(horizon, 3) / 3)
