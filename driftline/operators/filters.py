"""Recursive estimators over a recording: numpy kernels, one recording at a time, grouped by Spark.

The kernels take and return plain arrays and a state, so that the same step
serves a whole recording and the batches of a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftline.operators.lockstep import in_blocks, steps
from driftline.shipping import shipped


@dataclass
class Offset:
    """Random walk of the offset between two heights; innovations beyond the threshold inflate the noise."""

    walk_var: float
    noise_var: float
    threshold: float = 10.0
    value: float = 0.0
    var: float = -1.0
    t_us: int = 0

    def step(self, t_us: int, z: float) -> float:
        if self.var < 0:
            self.value, self.var = z, self.noise_var
        else:
            self.var += self.walk_var * max(t_us - self.t_us, 0) / 1e6
            d, r = z - self.value, self.noise_var
            if d * d > self.threshold * (self.var + r):
                r = d * d / self.threshold - self.var
            k = self.var / (self.var + r)
            self.value += k * d
            self.var *= 1 - k
        self.t_us = t_us
        return self.value


@dataclass
class Vertical:
    """Height, climb and acceleration bias from vertical acceleration and a height sensor."""

    acc_psd: float = 1e-2
    bias_psd: float = 1e-6
    height_var: float = 1.0
    threshold: float = 10.0
    x: np.ndarray = field(default_factory=lambda: np.zeros(3))
    p: np.ndarray = field(default_factory=lambda: np.diag([1.0, 1.0, 0.01]))
    t_us: int | None = None

    def predict(self, t_us: int, acc_up: float) -> None:
        dt = 0.0 if self.t_us is None else max(t_us - self.t_us, 0) / 1e6
        self.t_us = t_us
        h, v, b = self.x
        a = acc_up + b
        self.x = np.array([h + v * dt + a * dt * dt / 2, v + a * dt, b])
        f = np.array([[1, dt, dt * dt / 2], [0, 1, dt], [0, 0, 1]])
        self.p = f @ self.p @ f.T + np.diag([0, self.acc_psd * dt, self.bias_psd * dt])

    def update(self, row: np.ndarray, z: float, r: float) -> None:
        d, s = z - row @ self.x, row @ self.p @ row
        if self.threshold > 0 and d * d > self.threshold * (s + r):
            r = d * d / self.threshold - s
        k = self.p @ row / (s + r)
        self.x = self.x + k * d
        m = np.eye(3) - np.outer(k, row)
        self.p = m @ self.p @ m.T + np.outer(k, k) * r

    def height(self, z: float) -> None:
        self.update(np.array([1.0, 0, 0]), z, self.height_var)

    def standstill(self, sigma: float) -> None:
        self.update(np.array([0, 1.0, 0]), 0.0, sigma * sigma)


@dataclass
class Attitude:
    """Quaternion and gyro bias with levelling by specific force: error state of six, sequential updates."""

    gyro_psd: float = 1e-6
    bias_psd: float = 1e-10
    acc_sigma: float = 0.5
    penalty: float = 5.0
    q: np.ndarray | None = None
    bias: np.ndarray = field(default_factory=lambda: np.zeros(3))
    p: np.ndarray = field(default_factory=lambda: np.diag([0.01] * 3 + [1e-4] * 3))
    t_us: int | None = None

    @staticmethod
    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([[a[0] * b[0] - a[1:] @ b[1:]], a[0] * b[1:] + b[0] * a[1:] + np.cross(a[1:], b[1:])])

    @staticmethod
    def exponential(v: np.ndarray) -> np.ndarray:
        a = float(np.linalg.norm(v))
        return np.concatenate([[np.cos(a / 2)], v * (np.sin(a / 2) / a if a > 1e-9 else 0.5)])

    def matrix(self) -> np.ndarray:
        w, x, y, z = self.q
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])

    def step(self, t_us: int, gyr: np.ndarray, acc: np.ndarray, gravity: float = 9.80665) -> np.ndarray:
        """roll, pitch, yaw after the sample."""
        if self.q is None:
            roll, pitch = np.arctan2(-acc[1], -acc[2]), np.arctan2(acc[0], np.hypot(acc[1], acc[2]))
            self.q = self.product(self.exponential(np.array([0, pitch, 0])), self.exponential(np.array([roll, 0, 0])))
        dt = 0.0 if self.t_us is None else max(t_us - self.t_us, 0) / 1e6
        self.t_us = t_us
        r = self.matrix()
        self.q = self.product(self.q, self.exponential((gyr - self.bias) * dt))
        f = np.eye(6)
        f[:3, 3:] = -r * dt
        self.p = f @ self.p @ f.T + np.diag([self.gyro_psd * dt] * 3 + [self.bias_psd * dt] * 3)
        r = self.matrix()
        off = abs(float(np.linalg.norm(acc)) - gravity)
        var = min(self.acc_sigma + self.penalty * off, gravity) ** 2
        # Specific force at rest is the third row of the rotation, times minus gravity; an error e turns the local frame.
        up = np.array([0.0, 0.0, -gravity])
        h = np.zeros((3, 6))
        h[:, :3] = r.T @ np.array([[0, -up[2], up[1]], [up[2], 0, -up[0]], [-up[1], up[0], 0]])
        z = acc - r.T @ up
        dx = np.zeros(6)
        for i in range(3):
            s = h[i] @ self.p @ h[i] + var
            k = self.p @ h[i] / s
            dx = dx + k * (z[i] - h[i] @ dx)
            m = np.eye(6) - np.outer(k, h[i])
            self.p = m @ self.p @ m.T + np.outer(k, k) * var
        self.q = self.product(self.exponential(dx[:3]), self.q)
        self.q /= np.linalg.norm(self.q)
        self.bias = self.bias + dx[3:]
        return self.rpy()

    def rpy(self) -> np.ndarray:
        r = self.matrix()
        return np.array([np.arctan2(r[2, 1], r[2, 2]), np.arcsin(np.clip(-r[2, 0], -1, 1)), np.arctan2(r[1, 0], r[0, 0])])

    def correct(self, rows: list[tuple[float, np.ndarray, float]]) -> None:
        """rows: measured minus predicted, its derivative by the error state, variance."""
        dx = np.zeros(6)
        for z, h, var in rows:
            k = self.p @ h / (h @ self.p @ h + var)
            dx = dx + k * (z - h @ dx)
            m = np.eye(6) - np.outer(k, h)
            self.p = m @ self.p @ m.T + np.outer(k, k) * var
        self.q = self.product(self.exponential(dx[:3]), self.q)
        self.q /= np.linalg.norm(self.q)
        self.bias = self.bias + dx[3:]

    def heading(self, yaw: float, var: float) -> None:
        self.correct([((yaw - self.rpy()[2] + np.pi) % (2 * np.pi) - np.pi, np.array([0, 0, 1.0, 0, 0, 0]), var)])

    def magnetic(self, field: np.ndarray, var: float, declination: float = 0.0, strength: float = 0.0, tolerance: float = 0.3) -> None:
        """Yaw by the field's horizontal part; a strength that is off by more than its tolerance weakens the measurement."""
        roll, pitch, _ = self.rpy()
        off = abs(float(np.linalg.norm(field)) / strength - 1) if strength > 0 else 0.0
        x = field[0] * np.cos(pitch) + (field[1] * np.sin(roll) + field[2] * np.cos(roll)) * np.sin(pitch)
        y = field[1] * np.cos(roll) - field[2] * np.sin(roll)
        self.heading(float(np.arctan2(-y, x)) + declination, var * max(1.0, off / tolerance) ** 2)

    def rest(self, gyr_mean: np.ndarray, sigma: float = 1e-3) -> None:
        """No rotation: what the gyros show is their bias."""
        self.correct([(gyr_mean[i] - self.bias[i], np.eye(6)[3 + i], sigma**2) for i in range(3)])


def smoothed(f: np.ndarray, before: np.ndarray, after: np.ndarray, x_before: np.ndarray, x_after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rauch-Tung-Striebel pass over n steps: f[k] leads from k to k + 1; (x_)before[k] and after[k] are k's prediction and update."""
    x, p = x_after.copy(), after.copy()
    gain = after[:-1] @ f[: len(x) - 1].transpose(0, 2, 1)
    try:  # all gains at once; predictions are symmetric
        gain = np.linalg.solve(before[1:], gain.transpose(0, 2, 1)).transpose(0, 2, 1)
    except np.linalg.LinAlgError:
        gain = gain @ np.linalg.pinv(before[1:])
    for k in range(len(x) - 2, -1, -1):
        c = gain[k]
        x[k] = x_after[k] + c @ (x[k + 1] - x_before[k + 1])
        p[k] = after[k] + c @ (p[k + 1] - before[k + 1]) @ c.T
    return x, p


def per_recording(df: DataFrame, run, columns: str, also: tuple[str, ...] = ("t_us", "seq")) -> DataFrame:
    """run on each recording; returns recording_id and `also` with the types they have in df, then `columns` (DDL)."""
    shipped(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in ("recording_id", *also)] + (T._parse_datatype_string(columns).fields if columns else []))
    return df.groupBy("recording_id").applyInPandas(run, schema)


def offset_filter(df: DataFrame, walk_var: float, noise_var: float, threshold: float = 10.0) -> DataFrame:
    """recording_id, t_us, seq, estimate."""

    def run(frame: pd.DataFrame, start: np.ndarray) -> dict[str, np.ndarray]:
        from driftline.operators.parts import Offsets

        k, t, z, out = Offsets(len(start), walk_var, noise_var, threshold), frame["t_us"].to_numpy(np.int64), frame["value"].to_numpy(float), np.empty(len(frame))
        for j, i in steps(start, len(frame)):
            out[i] = k.step(j, t[i], z[i])
        return {"estimate": out}

    return in_blocks(df.select("recording_id", "t_us", "seq", "value"), run, "estimate double")


def vertical_filter(df: DataFrame, acc: str, height: str, smooth: bool = False) -> DataFrame:
    """recording_id, t_us, seq, h, v, bias; with smooth, the fixed-interval solution. Null heights only predict."""

    def run(frame: pd.DataFrame, start: np.ndarray) -> dict[str, np.ndarray]:
        from driftline.operators.parts import Verticals

        n, k, t = len(frame), Verticals(len(start)), frame["t_us"].to_numpy(np.int64)
        a, z = frame[acc].to_numpy(float), frame[height].to_numpy(float)
        xa, each = np.empty((n, 3)), list(steps(start, n))
        xb, pb, pa, fs = (np.empty((n, 3)), *(np.empty((n, 3, 3)) for _ in range(3))) if smooth else (None,) * 4
        for j, i in each:
            f = k.predict(j, t[i], a[i])
            if smooth:
                fs[i], xb[i], pb[i] = f, k.x[j], k.p[j]
            own = ~np.isnan(z[i])
            k.height(j[own], z[i[own]])
            xa[i] = k.x[j]
            if smooth:
                pa[i] = k.p[j]
        if smooth:  # backwards: each row that has one after it takes that one's correction
            gain = gains(fs, pb, pa, start)
            for _, i in reversed(each[1:]):
                xa[i - 1] += np.einsum("nij,nj->ni", gain[i], xa[i] - xb[i])
        return dict(zip(("h", "v", "bias"), xa.T, strict=True))

    return in_blocks(df.select("recording_id", "t_us", "seq", acc, height), run, "h double, v double, bias double")


def gains(f: np.ndarray, before: np.ndarray, after: np.ndarray, start: np.ndarray) -> np.ndarray:
    """What a row's correction is worth for the row before it, for all rows of a block but the recordings' first."""
    out = np.zeros_like(f)
    back = lambda own: after[own.start - 1 : own.stop - 1] @ f[own].transpose(0, 2, 1)
    solved = lambda own: np.linalg.solve(before[own], back(own).transpose(0, 2, 1)).transpose(0, 2, 1)  # noqa: E731  predictions are symmetric
    try:
        out[1:] = solved(slice(1, len(f)))
        return out
    except np.linalg.LinAlgError:
        pass  # then a recording at a time
    for a, b in zip(start, np.append(start[1:], len(f)), strict=True):
        own = slice(int(a) + 1, int(b))
        try:
            out[own] = solved(own)
        except np.linalg.LinAlgError:
            out[own] = back(own) @ np.linalg.pinv(before[own])
    return out


def attitude_filter(df: DataFrame) -> DataFrame:
    """recording_id, t_us, seq, roll, pitch, yaw of an imu stream."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t_us", "seq"])
        k = Attitude()
        g, a = frame[["gyr_x", "gyr_y", "gyr_z"]].to_numpy(), frame[["acc_x", "acc_y", "acc_z"]].to_numpy()
        rpy = np.array([k.step(int(t), g[i], a[i]) for i, t in enumerate(frame["t_us"])])
        return frame[["recording_id", "t_us", "seq"]].assign(roll=rpy[:, 0], pitch=rpy[:, 1], yaw=rpy[:, 2])

    return per_recording(df, run, "roll double, pitch double, yaw double")


def greedy_thinned(df: DataFrame, period_us: int) -> DataFrame:
    """Rows that are kept if at least a period has passed since the last one kept."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t_us", "seq"])
        keep, last = [], None
        for t in frame["t_us"]:
            keep.append(last is None or t - last >= period_us)
            last = t if keep[-1] else last
        return frame[np.array(keep, bool)]

    return per_recording(df.select("recording_id", "t_us", "seq", "value"), run, "", ("t_us", "seq", "value"))


def tumbling_variance(df: DataFrame, least_us: int, least_rows: int = 8) -> DataFrame:
    """Windows that close at the first row at least least_us after their start with least_rows rows: start, end, n, variance."""

    def run(key: tuple, frames: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        frame = frames.sort_values(["t_us", "seq"])
        out, start, n, mean, m2 = [], None, 0, 0.0, 0.0
        for t, x in zip(frame["t_us"], frame["value"], strict=True):
            start = t if start is None else start
            n += 1
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)
            if n >= least_rows and t - start >= least_us:
                out.append((key[0], start, t, n, m2 / (n - 1)))
                start, n, mean, m2 = None, 0, 0.0, 0.0
        return pd.DataFrame(out, columns=["recording_id", "t0_us", "t1_us", "n", "variance"])

    return per_recording(df.select("recording_id", "t_us", "seq", "value"), run, "t0_us long, t1_us long, n long, variance double", ())
