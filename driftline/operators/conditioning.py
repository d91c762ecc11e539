"""Measurements before they meet a filter: what cannot be is taken out, reported accuracies are made fit to be believed."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions.atmosphere import plausible
from driftline.operators.gates import finite

#: What no inertial sensor can have shown (rad/s, m/s2), the oldest measurement (s), the acceptance that the inverse is clamped to.
GYR_MOST, ACC_MOST, OLDEST_S, CHI2_RANGE = 100.0, 1.0e4, 0.5, (0.5, 0.99999994)


def chi2_threshold(acceptance: float) -> float:
    """The square that a standard normal number stays below with this probability; clamped at both ends, NaN at the lower one."""
    p = CHI2_RANGE[0] if math.isnan(acceptance) else min(max(acceptance, CHI2_RANGE[0]), CHI2_RANGE[1])
    return NormalDist().inv_cdf((1 + p) / 2) ** 2


def sanitized(df: DataFrame) -> DataFrame:
    """Aligned rows (operators/inertial.py, suite.py) whose blocks are whole and possible, else null: the columns stay the same.

    A block goes as a whole: an inertial sample with a value that is not finite or out of its range, a fix or velocity with a
    value that is not finite or a variance that is not positive, a pressure out of its range, a yaw beyond one full turn (others
    come into -pi to pi), measurements older than OLDEST_S. Covariances that are not finite become 0.
    """
    has = set(df.columns)
    blocks: list[tuple[list[str], Column]] = []
    for names, most in ((["gyr_x", "gyr_y", "gyr_z"], GYR_MOST), (["acc_x", "acc_y", "acc_z"], ACC_MOST)):
        if set(names) <= has:
            blocks.append((names, finite(*map(F.col, names)) & (F.greatest(*(F.abs(c) for c in names)) <= most)))
    if len(blocks) == 2:  # both or none: a filter needs the whole sample
        blocks = [([*blocks[0][0], *blocks[1][0]], blocks[0][1] & blocks[1][1])]
    fresh = lambda c: F.coalesce(F.col(c) <= OLDEST_S, F.lit(True)) if c in has else F.lit(True)
    for name in ("fix", "vel"):
        values, variances = [f"{name}_{a}" for a in "ned"], [f"{name}_var_{a}" for a in "ned"]
        if {*values, *variances} <= has:
            blocks.append(([*values, *variances], finite(*map(F.col, [*values, *variances])) & (F.least(*variances) > 0) & fresh("fix_age_s")))
    for value, var, ok, age in (("yaw", "yaw_var", lambda c: F.abs(c) <= 2 * math.pi, "yaw_age_s"), ("speed", "speed_var", lambda c: c >= 0, "speed_age_s"), ("baro_h", "baro_var", lambda c: F.lit(True), "")):
        if {value, var} <= has:
            blocks.append(([value, var], finite(F.col(value), F.col(var)) & ok(F.col(value)) & (F.col(var) > 0) & fresh(age)))
    if "pressure" in has:
        blocks.append((["pressure"], finite(F.col("pressure")) & plausible(F.col("pressure"))))
    magnet = ["mag_x", "mag_y", "mag_z"]
    if set(magnet) <= has:
        blocks.append((magnet, finite(*map(F.col, magnet))))
    out = {c: F.when(F.coalesce(ok, F.lit(False)), F.pmod(F.col(c) + math.pi, F.lit(2 * math.pi)) - math.pi if c == "yaw" else F.col(c)) for names, ok in blocks for c in names}
    out |= {c: F.when(finite(F.col(c)), F.col(c)).when(F.col(c).isNotNull(), 0.0) for c in ("fix_cov_ne", "fix_cov_nd", "fix_cov_ed") if c in has}
    return df.withColumns(out)


def accuracy_envelope(df: DataFrame, sigma: str, tau_s: float) -> DataFrame:
    """df with envelope: the greatest reported sigma, forgotten in proportion to the time since the report before, whole after tau_s.

    After each report the envelope is the larger of the report and (1 - dt / tau) of the one before; a step in time that is not
    forward keeps it. That is a product of factors, so a running maximum of log(sigma) less the sum of logs so far tells it:
    no recursion, a sort by recording. Reports that are null or not positive are left out.
    """
    w = W.partitionBy("recording_id").orderBy("t_us", "seq")
    rows = df.where(F.col(sigma) > 0).withColumn("__dt", (F.col("t_us") - F.lag("t_us").over(w)) / 1e6)
    rows = rows.withColumn("__new", F.coalesce(F.col("__dt") >= tau_s, F.lit(True)).cast("int")).withColumn("__part", F.sum("__new").over(w))
    held = F.when(F.col("__new") == 1, 0.0).otherwise(F.log(1 - F.greatest(F.col("__dt"), F.lit(0.0)) / tau_s))
    part = W.partitionBy("recording_id", "__part").orderBy("t_us", "seq")
    rows = rows.withColumn("__log", F.sum(held).over(part))
    return rows.withColumn("envelope", F.exp(F.max(F.log(sigma) - F.col("__log")).over(part) + F.col("__log"))).drop("__dt", "__new", "__part", "__log")


def antenna_acceleration(body_n: tuple[Column, ...], matrix: list[list[Column]], rate: tuple[Column, ...], arm: tuple[Column, ...]) -> list[Column]:
    """Acceleration of the antenna in north-east-down: the body's, and what a turn adds at the end of the arm (rate x (rate x arm))."""
    along = sum((rate[k] * arm[k] for k in range(1, 3)), rate[0] * arm[0])
    square = sum((rate[k] * rate[k] for k in range(1, 3)), rate[0] * rate[0])
    turn = [rate[k] * along - square * arm[k] for k in range(3)]
    return [body_n[i] + sum((matrix[i][k] * turn[k] for k in range(1, 3)), matrix[i][0] * turn[0]) for i in range(3)]


def manoeuvre_variance(acc_n: list[Column], horizontal: float, vertical: float) -> list[Column]:
    """What a velocity's variances north, east and down gain under an acceleration: the receiver averages, the state does not."""
    flat = (horizontal**2) * (acc_n[0] * acc_n[0] + acc_n[1] * acc_n[1])
    return [flat, flat, (vertical**2) * acc_n[2] * acc_n[2]]


def bias_prior(still: DataFrame, acc_sigma: float, gyr_sigma: float, least_s: float = 10.0, least: int = 200, factor: float = 4.0, gravity: float = 9.80665, earth_rate: float = 7.292115e-5) -> DataFrame:
    """recording_id, phase, t0_us, t1_us, n, acc_off, gyr_off, acc_exceeded, gyr_exceeded: whether rest reads more than a bias's prior allows.

    still: recording_id, phase (a run of rest), t_us and the inertial columns. Each phase is cut into windows of least_s from its start; those with `least` rows count.
    """
    from_us = F.min("t_us").over(W.partitionBy("recording_id", "phase"))
    rows = still.withColumn("__k", F.floor((F.col("t_us") - from_us) / (least_s * 1e6)))
    g = rows.groupBy("recording_id", "phase", "__k").agg(F.min("t_us").alias("t0_us"), F.max("t_us").alias("t1_us"), F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for s in ("acc", "gyr") for c in (f"{s}_x", f"{s}_y", f"{s}_z")))
    norm = lambda s: F.sqrt(sum((F.col(f"{s}_{a}") ** 2 for a in "xyz"), F.lit(0.0)))
    out = g.where(F.col("n") >= least).withColumns({"acc_off": F.abs(norm("acc") - gravity), "gyr_off": norm("gyr")})
    return out.select("recording_id", "phase", "t0_us", "t1_us", "n", "acc_off", "gyr_off", (F.col("acc_off") > factor * acc_sigma).alias("acc_exceeded"), (F.col("gyr_off") > factor * max(gyr_sigma, earth_rate)).alias("gyr_exceeded"))
