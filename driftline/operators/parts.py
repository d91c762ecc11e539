"""The parts of the suite for many recordings in one step: gates, stillness, levelling, attitude, height and offset.

Each does what the class of the singular name does, with a leading axis of recordings. Methods take the numbers `j` of the
recordings they step, and values with a row for each of them. Times that are not known yet are marked by NEVER.
"""

from __future__ import annotations

import numpy as np

from driftline.operators.filters import Attitude, Offset, Vertical
from driftline.operators.fleet import exponential, gained, levelled, matrix, product, rpy, turned, unit
from driftline.operators.modes import ATTITUDE, COASTING, FULL, NONE, Gate
from driftline.operators.stillness import GRAVITY, LevelWindow, Still

NEVER = np.iinfo(np.int64).min
IMU_LOSS, ENTER, QUALITY_LOSS, REACQUIRE = range(1, 5)
#: Names of events by number; 0 is none.
EVENT_NAMES = np.array([None, "imu_loss", "enter", "quality_loss", "reacquire"], object)


def never(n: int) -> np.ndarray:
    return np.full(n, NEVER, np.int64)


def since(t_us: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Microseconds since then; infinite where that never was."""
    return np.where(then == NEVER, np.inf, t_us - np.where(then == NEVER, t_us, then))


class Gates:
    def __init__(self, n: int, one: Gate) -> None:
        self.one = one
        self.running, self.count, self.bad_s = np.zeros(n, bool), np.zeros(n, int), np.zeros(n)
        self.since, self.last, self.bad_last, self.used, self.imu = (never(n) for _ in range(5))

    def stopped(self, j: np.ndarray) -> None:
        self.running[j], self.since[j], self.last[j], self.count[j], self.bad_s[j], self.bad_last[j] = False, NEVER, NEVER, 0, 0.0, NEVER

    def step(self, j: np.ndarray, t_us: np.ndarray, offered: np.ndarray, entry: np.ndarray, stay: np.ndarray, sample: np.ndarray) -> np.ndarray:
        one, event = self.one, np.zeros(len(j), int)
        lost = self.running[j] & (self.imu[j] != NEVER) & (since(t_us, self.imu[j]) > one.imu_s * 1e6)
        self.stopped(j[lost])
        event[lost] = IMU_LOSS
        self.imu[j[sample]] = t_us[sample]
        running = self.running[j]
        out = j[offered & ~running & ~entry]
        self.since[out], self.last[out], self.count[out] = NEVER, NEVER, 0
        if (own := offered & ~running & entry).any():
            i, t = j[own], t_us[own]
            fresh = (self.since[i] == NEVER) | (t < self.last[i]) | (since(t, self.last[i]) > one.gap_s * 1e6)
            self.since[i] = np.where(fresh, t, self.since[i])
            self.last[i], self.count[i] = t, np.where(fresh, 0, self.count[i]) + 1
            enter = (t - self.since[i] >= one.dwell_s * 1e6) & (self.count[i] >= int(one.dwell_s * one.least_hz + 0.5))
            i = i[enter]
            self.running[i], self.used[i], self.bad_s[i], self.bad_last[i] = True, t[enter], 0.0, NEVER
            event[np.flatnonzero(own)[enter]] = ENTER
        if (own := offered & running & stay).any():
            i, t = j[own], t_us[own]
            event[own] = np.where(t - self.used[i] > one.coast_s * 1e6, REACQUIRE, event[own])
            self.used[i], self.bad_s[i], self.bad_last[i] = t, 0.0, NEVER
        if (own := offered & running & ~stay).any():
            i, t = j[own], t_us[own]
            first = (self.bad_last[i] == NEVER) | (t < self.bad_last[i])
            self.bad_s[i] = np.where(first, 0.0, self.bad_s[i] + np.minimum(since(t, self.bad_last[i]) / 1e6, one.stop_step_s))
            self.bad_last[i] = t
            over = ~first & (self.bad_s[i] >= one.stop_s)
            self.stopped(i[over])
            event[np.flatnonzero(own)[over]] = QUALITY_LOSS
        return event

    def mode(self, j: np.ndarray, t_us: np.ndarray, attitude: np.ndarray | bool = True) -> np.ndarray:
        age = np.where(self.running[j], since(t_us, self.used[j]) / 1e6, np.inf)
        return np.where(age <= self.one.fresh_s, FULL, np.where(age <= self.one.coast_s, COASTING, np.where(attitude, ATTITUDE, NONE)))


class Stills:
    def __init__(self, n: int, one: Still) -> None:
        self.one = one
        self.n, self.constant, self.gyr_n = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
        self.start, self.since, self.fired, self.speed_at = (never(n) for _ in range(4))
        self.mean, self.m2, self.gyr_sum, self.speed = np.zeros((n, 6)), np.zeros((n, 6)), np.zeros((n, 3)), np.zeros(n)
        self.verdict, self.active = np.zeros(n, bool), np.zeros(n, bool)

    def window(self, j: np.ndarray, t_us: np.ndarray, x: np.ndarray) -> np.ndarray:
        one = self.one
        first = (self.n[j] == 0) | (t_us < self.start[j])
        i = j[first]
        self.start[i], self.n[i], self.mean[i], self.m2[i] = t_us[first], 1, x[first], 0.0
        i, t, x = j[~first], t_us[~first], x[~first]
        self.n[i] += 1
        off = x - self.mean[i]
        self.mean[i] += off / self.n[i][:, None]
        self.m2[i] += off * (x - self.mean[i])
        i = i[(self.n[i] >= one.least) & (t - self.start[i] >= one.window_s * 1e6)]
        gyr, acc, freedom = self.m2[i, :3].sum(1), self.m2[i, 3:].sum(1), 3.0 * (self.n[i] - 1)
        self.constant[i] = np.where(gyr > 0, 0, np.minimum(self.constant[i] + 1, one.frozen_windows))
        frozen = (acc <= 0) | (self.constant[i] >= one.frozen_windows)
        self.verdict[i] = ~frozen & ((gyr / freedom) ** 0.5 <= one.gyr_sigma) & ((acc / freedom) ** 0.5 <= one.acc_sigma)
        self.n[i] = 0
        return self.verdict[j]

    def step(self, j: np.ndarray, t_us: np.ndarray, gyr: np.ndarray, acc: np.ndarray, gyr_bias: np.ndarray, speed: np.ndarray) -> np.ndarray:
        """Whether an update is due; a speed that is NaN is none."""
        one, known = self.one, ~np.isnan(speed)
        self.speed[j[known]], self.speed_at[j[known]] = speed[known], t_us[known]
        still = self.window(j, t_us, np.concatenate([gyr, acc], 1))
        slow = (since(t_us, self.speed_at[j]) > one.speed_age_s * 1e6) | (self.speed[j] <= one.max_speed)
        rests = still & slow & (np.linalg.norm(gyr - gyr_bias, axis=1) <= one.gyr_bound) & (np.abs(np.linalg.norm(acc, axis=1) - GRAVITY) <= one.acc_bound)
        i = j[~rests]
        self.since[i], self.active[i], self.gyr_sum[i], self.gyr_n[i] = NEVER, False, 0.0, 0
        i, t = j[rests], t_us[rests]
        self.since[i] = np.where(self.since[i] == NEVER, t, self.since[i])
        self.gyr_sum[i] += gyr[rests]
        self.gyr_n[i] += 1
        self.active[i] = t - self.since[i] >= one.dwell_s * 1e6
        fires = self.active[i] & ((self.fired[i] == NEVER) | (since(t, self.fired[i]) >= one.every_s * 1e6))
        self.fired[i[fires]] = t[fires]
        due = np.zeros(len(j), bool)
        due[np.flatnonzero(rests)[fires]] = True
        return due

    def gyr_mean(self, j: np.ndarray) -> np.ndarray:
        out = self.gyr_sum[j] / np.maximum(self.gyr_n[j], 1)[:, None]
        self.gyr_sum[j], self.gyr_n[j] = 0.0, 0
        return out


class Levels:
    def __init__(self, n: int, one: LevelWindow) -> None:
        self.one = one
        self.times, self.rates, self.forces = np.zeros((n, one.size), np.int64), np.zeros((n, one.size)), np.zeros((n, one.size, 3))
        self.newest, self.n = np.zeros(n, int), np.zeros(n, int)

    def push(self, j: np.ndarray, t_us: np.ndarray, gyr: np.ndarray, acc: np.ndarray) -> None:
        self.n[j[(self.n[j] > 0) & (t_us < self.times[j, self.newest[j]])]] = 0
        at = self.newest[j] = (self.newest[j] + 1) % self.one.size
        self.n[j] = np.minimum(self.n[j] + 1, self.one.size)
        self.times[j, at], self.rates[j, at], self.forces[j, at] = t_us, np.linalg.norm(gyr, axis=1), acc

    def inside(self, j: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The places in the window, and whether they are enough."""
        size, newest = self.one.size, self.newest[j][:, None]
        back = (newest - np.arange(size)) % size  # how far before the newest
        from_us = self.times[j][np.arange(len(j)), self.newest[j]] - self.one.window_s * 1e6
        own = (back < self.n[j][:, None]) & (self.times[j] >= from_us[:, None])
        enough = own.sum(1) >= 3
        if whole:
            oldest = self.times[j, (self.newest[j] - self.n[j] + 1) % size]
            enough &= (self.n[j] >= size) | (oldest <= from_us)
        return own, enough

    def solve(self, j: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether there is a level, roll, pitch, and the least sigma to start with."""
        one = self.one
        own, enough = self.inside(j, whole)
        k, each = np.maximum(own.sum(1), 1), np.arange(len(j))
        x = np.sort(np.where(own[:, :, None], self.forces[j], np.inf), axis=1)
        fx, fy, fz = ((x[each, (k - 1) // 2] + x[each, k // 2]) / 2).T
        rest = (np.where(own, self.rates[j], 0.0).max(1) <= one.still_gyr) & (np.abs((fx * fx + fy * fy + fz * fz) ** 0.5 - GRAVITY) <= one.still_acc)
        return enough, np.arctan2(-fy, -fz), np.arctan2(fx, np.hypot(fy, fz)), np.where(rest, 0.0, one.moving_sigma)


class Attitudes:
    def __init__(self, n: int) -> None:
        self.one = one = Attitude()
        self.on, self.t_us = np.zeros(n, bool), np.zeros(n, np.int64)
        self.q, self.bias, self.p = np.zeros((n, 4)), np.zeros((n, 3)), np.repeat(one.p[None], n, 0)

    def begin(self, j: np.ndarray, t_us: np.ndarray, roll: np.ndarray, pitch: np.ndarray, sigma: np.ndarray) -> None:
        self.on[j], self.t_us[j], self.q[j], self.bias[j], self.p[j] = True, t_us, levelled(roll, pitch), 0.0, self.one.p
        self.p[j, 0, 0] = self.p[j, 1, 1] = np.maximum(np.radians(10.0), sigma) ** 2

    def step(self, j: np.ndarray, t_us: np.ndarray, gyr: np.ndarray, acc: np.ndarray, gravity: float = 9.80665) -> None:
        one, n = self.one, len(j)
        if not n:
            return
        dt = (np.maximum(t_us - self.t_us[j], 0) / 1e6)[:, None]
        self.t_us[j] = t_us
        f = np.repeat(np.eye(6)[None], n, 0)
        f[:, :3, 3:] = -matrix(self.q[j]) * dt[:, :, None]
        self.q[j] = product(self.q[j], exponential((gyr - self.bias[j]) * dt))
        p, k = f @ self.p[j] @ f.transpose(0, 2, 1), np.arange(6)
        p[:, k, k] += np.repeat([one.gyro_psd, one.bias_psd], 3) * dt
        self.p[j] = p
        var = np.minimum(one.acc_sigma + one.penalty * np.abs(np.linalg.norm(acc, axis=1) - gravity), gravity) ** 2
        up, back = np.array([0.0, 0.0, -gravity]), matrix(self.q[j]).transpose(0, 2, 1)
        h = np.zeros((n, 3, 6))
        h[:, :, :3] = back @ np.array([[0, -up[2], up[1]], [up[2], 0, -up[0]], [-up[1], up[0], 0]])
        z = acc - back @ up
        self.correct(j, [(z[:, i], h[:, i], var) for i in range(3)])

    def correct(self, j: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        if not len(j):
            return
        dx, p = np.zeros((len(j), 6)), self.p[j]
        for z, h, var in rows:
            b = turned(p, h)
            k = b / ((h * b).sum(1) + var)[:, None]
            dx += k * (z - (h * dx).sum(1))[:, None]
            p = gained(p, h, k, var)
        self.p[j], self.bias[j] = p, self.bias[j] + dx[:, 3:]
        self.q[j] = unit(product(exponential(dx[:, :3]), self.q[j]))

    def magnetic(self, j: np.ndarray, field: np.ndarray, var: float, declination: float) -> None:
        roll, pitch, yaw = rpy(self.q[j]).T
        x = field[:, 0] * np.cos(pitch) + (field[:, 1] * np.sin(roll) + field[:, 2] * np.cos(roll)) * np.sin(pitch)
        y = field[:, 1] * np.cos(roll) - field[:, 2] * np.sin(roll)
        off = np.arctan2(-y, x) + declination - yaw
        self.correct(j, [((off + np.pi) % (2 * np.pi) - np.pi, np.tile(np.eye(6)[2], (len(j), 1)), np.full(len(j), var))])

    def rest(self, j: np.ndarray, gyr_mean: np.ndarray, sigma: float = 1e-3) -> None:
        z = gyr_mean - self.bias[j]
        self.correct(j, [(z[:, i], np.tile(np.eye(6)[3 + i], (len(j), 1)), np.full(len(j), sigma**2)) for i in range(3)])


class Verticals:
    def __init__(self, n: int, **settings) -> None:
        self.one = one = Vertical(**settings)
        self.on, self.t_us = np.zeros(n, bool), never(n)
        self.x, self.p = np.zeros((n, 3)), np.repeat(one.p[None], n, 0)

    def begin(self, j: np.ndarray, t_us: np.ndarray, height: np.ndarray) -> None:
        self.on[j], self.t_us[j], self.x[j], self.p[j] = True, t_us, 0.0, self.one.p
        self.x[j, 0] = height

    def predict(self, j: np.ndarray, t_us: np.ndarray, acc_up: np.ndarray) -> np.ndarray:
        """The transition."""
        dt = np.where(self.t_us[j] == NEVER, 0.0, np.maximum(t_us - np.where(self.t_us[j] == NEVER, t_us, self.t_us[j]), 0) / 1e6)
        self.t_us[j] = t_us
        h, v, b = self.x[j].T
        a = acc_up + b
        self.x[j] = np.stack([h + v * dt + a * dt * dt / 2, v + a * dt, b], 1)
        f = np.repeat(np.eye(3)[None], len(j), 0)
        f[:, 0, 1] = f[:, 1, 2] = dt
        f[:, 0, 2] = dt * dt / 2
        p = f @ self.p[j] @ f.transpose(0, 2, 1)
        p[:, 1, 1] += self.one.acc_psd * dt
        p[:, 2, 2] += self.one.bias_psd * dt
        self.p[j] = p
        return f

    def update(self, j: np.ndarray, c: int, z: np.ndarray | float, r: float) -> None:
        """A measurement of the state's part c."""
        if not len(j):
            return
        x, p, threshold = self.x[j], self.p[j], self.one.threshold
        d, s, r = z - x[:, c], p[:, c, c], np.full(len(j), r)
        if threshold > 0:
            r = np.where(d * d > threshold * (s + r), d * d / threshold - s, r)
        k = p[:, :, c] / (s + r)[:, None]
        self.x[j] = x + k * d[:, None]
        self.p[j] = gained(p, np.tile(np.eye(3)[c], (len(j), 1)), k, r)

    def height(self, j: np.ndarray, z: np.ndarray) -> None:
        self.update(j, 0, z, self.one.height_var)

    def standstill(self, j: np.ndarray, sigma: float) -> None:
        self.update(j, 1, 0.0, sigma * sigma)


class Offsets:
    def __init__(self, n: int, walk_var: float, noise_var: float | np.ndarray, threshold: float = Offset.threshold) -> None:
        self.walk_var, self.noise_var, self.threshold = walk_var, np.zeros(n) + noise_var, threshold
        self.value, self.var, self.t_us = np.zeros(n), np.full(n, -1.0), np.zeros(n, np.int64)

    def step(self, j: np.ndarray, t_us: np.ndarray, z: np.ndarray) -> np.ndarray:
        first, r = self.var[j] < 0, self.noise_var[j]
        var = self.var[j] + self.walk_var * np.maximum(t_us - self.t_us[j], 0) / 1e6
        d = z - self.value[j]
        noise = np.where(d * d > self.threshold * (var + r), d * d / self.threshold - var, r)
        k = var / (var + noise)
        self.value[j], self.var[j], self.t_us[j] = np.where(first, z, self.value[j] + k * d), np.where(first, r, var * (1 - k)), t_us
        return self.value[j]
