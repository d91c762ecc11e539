"""Calibration of an inertial sensor that was laid down in many poses.

At rest every pose reads gravity, and between two poses the gyros turn the one
direction of gravity into the next. What counts as rest is not known beforehand: a
sweep over thresholds, multiples of the quiet part of the first rest, finds the
poses for each; the fit with the least cost is kept.

The sweep is one pass of windows over the rows; only a mean for each pose goes on.
The fits run for each recording in tasks of their own. The gyros need the samples
between the poses, a recording at a time, all turns integrated as one batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.operators.calibration import levenberg
from driftline.shipping import shipped

ACC, GYR = ("acc_x", "acc_y", "acc_z"), ("gyr_x", "gyr_y", "gyr_z")
#: Rows of the variance window, rows of a pose at least, poses at least, multiples of the quiet variance.
WINDOW, LEAST_ROWS, LEAST_POSES, MULTIPLES = 101, 100, 12, tuple(range(2, 11))


def spread(columns: tuple[str, ...], window: int) -> Column:
    """Length of the vector of variances over a centred window of rows; null where the window is not whole."""
    w = W.partitionBy("recording_id").orderBy("t_us", "seq").rowsBetween(-(window // 2), window // 2)
    return F.when(F.count(F.lit(1)).over(w) == window // 2 * 2 + 1, F.sqrt(sum((F.pow(F.var_samp(c).over(w), 2) for c in columns), F.lit(0.0))))


def pose_sweep(df: DataFrame, columns: tuple[str, ...] = ACC, also: tuple[str, ...] = (), window: int = WINDOW, rest_s: float = 20.0, multiples: tuple[int, ...] = MULTIPLES, least_rows: int = LEAST_ROWS) -> DataFrame:
    """recording_id, multiple, t0_us, t1_us, n, and the means of columns and also: runs of rows at rest, for each multiple of the quiet variance.

    The quiet variance is the tenth percentile over the first rest_s.
    """
    order = W.partitionBy("recording_id").orderBy("t_us", "seq")
    rows = df.select("recording_id", "t_us", "seq", *columns, *also).withColumn("v", spread(columns, window)).withColumn("k", F.row_number().over(order)).withColumn("from", F.min("t_us").over(W.partitionBy("recording_id")))
    quiet = rows.where(F.col("t_us") <= F.col("from") + int(rest_s * 1e6)).groupBy("recording_id").agg(F.percentile("v", F.lit(0.1)).alias("quiet"))
    # A row is at rest for the multiples above its own ratio: those alone are made.
    level = F.floor(F.col("v") / F.col("quiet")) + 1
    each = rows.join(quiet, "recording_id").where(F.col("quiet") > 0).where(level <= max(multiples))
    each = each.withColumn("multiple", F.explode(F.filter(F.array(*map(F.lit, multiples)), lambda m: m >= level)))
    runs = each.withColumn("run", F.col("k") - F.row_number().over(W.partitionBy("recording_id", "multiple").orderBy("k")))
    found = runs.groupBy("recording_id", "multiple", "run").agg(F.min("t_us").alias("t0_us"), F.max("t_us").alias("t1_us"), F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in (*columns, *also)))
    return found.where(F.col("n") >= least_rows).drop("run")


def acc_model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and bias of nine parameters: three angles between the axes, three scales, three biases."""
    return np.array([[1, -p[0], p[1]], [0, 1, -p[2]], [0, 0, 1]]) @ np.diag(p[3:6]), p[6:9]


def fit_poses(means: np.ndarray, gravity: float, angles: bool = True) -> tuple[np.ndarray, float]:
    """Parameters of acc_model for the mean reading of each pose, and the sum of squares that is left."""

    def off(p: np.ndarray) -> np.ndarray:
        m, b = acc_model(p)
        return np.linalg.norm((means - b) @ m.T, axis=1) - gravity

    return levenberg(off, np.array([0, 0, 0, 1.0, 1, 1, 0, 0, 0]), free=None if angles else range(3, 9))


class Turns:
    """The turns between poses as one batch: steps padded with rests to the longest turn, multiplied pairwise."""

    def __init__(self, gyr: np.ndarray, t_s: np.ndarray, spans: list[tuple[int, int]]):
        width = max((b - a for a, b in spans), default=0)
        self.rate, self.dt = np.zeros((len(spans), width, 3)), np.zeros((len(spans), width))
        for k, (a, b) in enumerate(spans):
            self.rate[k, : b - a] = (gyr[a:b] + gyr[a + 1 : b + 1]) / 2
            self.dt[k, : b - a] = np.diff(t_s[a : b + 1])

    def quaternions(self, m: np.ndarray, b: np.ndarray) -> np.ndarray:
        v = (self.rate - b) @ m.T * self.dt[..., None]
        angle = np.linalg.norm(v, axis=-1, keepdims=True)
        q = np.concatenate([np.cos(angle / 2), v * np.where(angle > 1e-9, np.sin(angle / 2) / np.maximum(angle, 1e-12), 0.5)], -1)
        while q.shape[1] > 1:
            if q.shape[1] % 2:
                q = np.concatenate([q, np.broadcast_to([1.0, 0, 0, 0], (len(q), 1, 4))], 1)
            a, c = q[:, 0::2], q[:, 1::2]
            q = np.concatenate([a[..., :1] * c[..., :1] - (a[..., 1:] * c[..., 1:]).sum(-1, keepdims=True), a[..., :1] * c[..., 1:] + c[..., :1] * a[..., 1:] + np.cross(a[..., 1:], c[..., 1:])], -1)
        return q[:, 0] if q.shape[1] else np.tile([1.0, 0, 0, 0], (len(q), 1))

    def carried(self, m: np.ndarray, b: np.ndarray, directions: np.ndarray) -> np.ndarray:
        """Where each turn takes a direction that is fixed outside, seen from the body."""
        q = self.quaternions(m, b)
        w, u = q[:, :1], -q[:, 1:]
        return directions + 2 * np.cross(u, np.cross(u, directions) + w * directions)


def fit_turns(turns: Turns, before: np.ndarray, after: np.ndarray, bias: np.ndarray, angles: bool = True, bias_too: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Matrix and bias of the gyros, and the sum of squares left: each turn has to take a pose's gravity to the next one's."""
    unpack = lambda p: (p[:9].reshape(3, 3), bias + p[9:])
    free = [*(range(9) if angles else (0, 4, 8)), *((9, 10, 11) if bias_too else ())]
    p, cost = levenberg(lambda p: (turns.carried(*unpack(p), before) - after).ravel(), np.concatenate([np.eye(3).ravel(), np.zeros(3)]), free=free)
    return *unpack(p), cost


def pose_calibration(df: DataFrame, gravity: float = 9.80665, window: int = WINDOW, rest_s: float = 20.0, multiples: tuple[int, ...] = MULTIPLES, least_rows: int = LEAST_ROWS, least_poses: int = LEAST_POSES, angles: bool = True) -> DataFrame:
    """A row for each recording that has poses enough: multiple, poses, matrices (nine numbers, by rows) and biases of both sensors, and errors before and after.

    df: recording_id, t_us, seq, ACC and GYR in SI units. acc_raw_rms, acc_rms: of the length of gravity over the poses;
    gyr_raw_rms, gyr_rms: of the angle (rad) by which a turn misses the next pose's gravity. A corrected reading is matrix times
    (reading minus bias).
    """
    shipped(df.sparkSession)
    kind = df.schema["recording_id"].dataType.simpleString()
    poses = pose_sweep(df, ACC, GYR, window, rest_s, multiples, least_rows)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t0_us")
        if len(frame) < least_poses:
            return pd.DataFrame(columns=["recording_id", "multiple", "cost", "p", "t0", "t1"])
        p, cost = fit_poses(frame[list(ACC)].to_numpy(float), gravity, angles)
        return pd.DataFrame([{"recording_id": frame["recording_id"].iloc[0], "multiple": frame["multiple"].iloc[0], "cost": cost / len(frame), "p": p, "t0": frame["t0_us"].to_numpy(), "t1": frame["t1_us"].to_numpy()}])

    fits = poses.groupBy("recording_id", "multiple").applyInPandas(fit, f"recording_id {kind}, multiple int, cost double, p array<double>, t0 array<bigint>, t1 array<bigint>")
    best = fits.withColumn("r", F.row_number().over(W.partitionBy("recording_id").orderBy("cost", "multiple"))).where("r = 1").drop("r")

    def solve(key: tuple, rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if not len(chosen) or not len(rows):
            return pd.DataFrame(columns=names)
        c, rows = chosen.iloc[0], rows.sort_values(["t_us", "seq"])
        t, acc, gyr = rows["t_us"].to_numpy(np.int64), rows[list(ACC)].to_numpy(float), rows[list(GYR)].to_numpy(float)
        m, b = acc_model(np.array(c["p"]))
        lo, hi = np.searchsorted(t, c["t0"], "left"), np.searchsorted(t, c["t1"], "right")
        means = np.array([acc[a:z].mean(0) for a, z in zip(lo, hi, strict=True)])
        mended = (means - b) @ m.T
        rms = lambda x: float(np.sqrt(np.mean(np.square(x))))
        length = lambda x: np.linalg.norm(x, axis=1) - gravity
        way = mended / np.linalg.norm(mended, axis=1, keepdims=True)
        turns = Turns(gyr, t / 1e6, [(int(a) - 1, int(z)) for a, z in zip(hi[:-1], lo[1:], strict=True)])
        rest = gyr[lo[0] : hi[0]]  # the first rest; the median shrugs off a knock
        gm, gb, _ = fit_turns(turns, way[:-1], way[1:], np.median(rest, axis=0), angles)
        miss = lambda m, b: np.arccos(np.clip((turns.carried(m, b, way[:-1]) * way[1:]).sum(1), -1, 1))
        return pd.DataFrame([[key[0], int(c["multiple"]), len(means), m.ravel(), b, gm.ravel(), gb, rms(length(means)), rms(length(mended)), rms(miss(np.eye(3), np.zeros(3))), rms(miss(gm, gb))]], columns=names)

    names = ["recording_id", "multiple", "poses", "acc_matrix", "acc_bias", "gyr_matrix", "gyr_bias", "acc_raw_rms", "acc_rms", "gyr_raw_rms", "gyr_rms"]
    schema = f"recording_id {kind}, multiple int, poses int, acc_matrix array<double>, acc_bias array<double>, gyr_matrix array<double>, gyr_bias array<double>, acc_raw_rms double, acc_rms double, gyr_raw_rms double, gyr_rms double"
    own = df.select("recording_id", "t_us", "seq", *ACC, *GYR)
    return own.groupBy("recording_id").cogroup(best.groupBy("recording_id")).applyInPandas(solve, schema)


def quality_warnings(result: DataFrame, least_poses: int = 18, most_acc: float = 0.05, most_gyr: float = 0.02, most_bias: float = 0.5, most_gyr_bias: float = 0.05) -> DataFrame:
    """recording_id, warning: what speaks against a calibration."""
    far = lambda c, limit: F.exists(c, lambda x: F.abs(x) > limit)
    rules = {
        "few_poses": F.col("poses") < least_poses, "acc_residual": F.col("acc_rms") > most_acc, "gyr_residual": F.col("gyr_rms") > most_gyr, "acc_no_better": F.col("acc_rms") >= F.col("acc_raw_rms"),
        "acc_bias": far("acc_bias", most_bias), "gyr_bias": far("gyr_bias", most_gyr_bias),
    }
    return result.select("recording_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("warning"))


def mounted(m: np.ndarray, b: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and bias for the axes of what the sensor is mounted in: the same correction, then the rotation."""
    return rotation @ m, b


