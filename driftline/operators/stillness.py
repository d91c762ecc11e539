"""Automatic stillness and levelling: what a filter takes from its own samples while the platform rests."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from driftline.operators.filters import per_recording
from driftline.operators.lockstep import in_blocks, steps

GRAVITY = 9.80665


@dataclass
class Still:
    """Stillness by bounds on rate and specific force, confirmed by the variance of the last whole window, after a dwell.

    The bounds are for a sensor with biases, the variance is what tells rest from motion: windows of at least window_s and
    `least` samples close one after the other, and the last verdict holds until the next one. A window without any spread
    is a frozen sensor, not rest. A velocity known from elsewhere vetoes while it is fresh.
    """

    gyr_bound: float = np.radians(5.0)
    acc_bound: float = 0.5
    gyr_sigma: float = np.radians(0.1)
    acc_sigma: float = 0.15
    window_s: float = 0.2
    least: int = 8
    dwell_s: float = 0.2
    every_s: float = 0.2
    frozen_windows: int = 10
    max_speed: float = 1.5
    speed_age_s: float = 2.0
    start: int | None = None
    n: int = 0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(6))
    m2: np.ndarray = field(default_factory=lambda: np.zeros(6))
    verdict: bool = False
    constant: int = 0
    since: int | None = None
    fired: int | None = None
    speed: float = 0.0
    speed_at: int | None = None
    active: bool = False
    gyr_sum: np.ndarray = field(default_factory=lambda: np.zeros(3))
    gyr_n: int = 0

    def window(self, t_us: int, x: np.ndarray) -> bool:
        """The verdict after this sample (rate and force)."""
        if self.n == 0 or t_us < self.start:
            self.start, self.n, self.mean, self.m2 = t_us, 1, x.astype(float), np.zeros(6)
            return self.verdict
        self.n += 1
        off = x - self.mean
        self.mean = self.mean + off / self.n
        self.m2 = self.m2 + off * (x - self.mean)
        if self.n >= self.least and t_us - self.start >= self.window_s * 1e6:
            gyr, acc = self.m2[:3].sum(), self.m2[3:].sum()
            self.constant = 0 if gyr > 0 else min(self.constant + 1, self.frozen_windows)
            frozen = acc <= 0 or self.constant >= self.frozen_windows
            freedom = 3.0 * (self.n - 1)
            self.verdict = not frozen and (gyr / freedom) ** 0.5 <= self.gyr_sigma and (acc / freedom) ** 0.5 <= self.acc_sigma
            self.n = 0
        return self.verdict

    def step(self, t_us: int, gyr: np.ndarray, acc: np.ndarray, gyr_bias: np.ndarray = np.zeros(3), acc_bias: np.ndarray = np.zeros(3), speed: float | None = None) -> bool:
        """Whether a standstill update is due at this sample; `active` tells whether the platform rests."""
        if speed is not None:
            self.speed, self.speed_at = speed, t_us
        still = self.window(t_us, np.concatenate([gyr, acc]))
        slow = self.speed_at is None or t_us - self.speed_at > self.speed_age_s * 1e6 or self.speed <= self.max_speed
        bounds = np.linalg.norm(gyr - gyr_bias) <= self.gyr_bound and abs(np.linalg.norm(acc - acc_bias) - GRAVITY) <= self.acc_bound and slow
        if not (bounds and still):
            self.since, self.active, self.gyr_sum, self.gyr_n = None, False, np.zeros(3), 0
            return False
        self.since = t_us if self.since is None else self.since
        self.gyr_sum, self.gyr_n = self.gyr_sum + gyr, self.gyr_n + 1
        self.active = t_us - self.since >= self.dwell_s * 1e6
        if not self.active or (self.fired is not None and t_us - self.fired < self.every_s * 1e6):
            return False
        self.fired = t_us
        return True

    def gyr_mean(self) -> np.ndarray:
        """Mean rate since the last time it was asked for, or since rest began."""
        out = self.gyr_sum / max(self.gyr_n, 1)
        self.gyr_sum, self.gyr_n = np.zeros(3), 0
        return out


@dataclass
class LevelWindow:
    """A ring of the newest samples and the level that their medians solve."""

    window_s: float = 0.1
    size: int = 64
    still_gyr: float = 0.04
    still_acc: float = 0.2
    moving_sigma: float = np.radians(15.0)
    samples: deque = field(default_factory=deque)

    def push(self, t_us: int, gyr: np.ndarray, acc: np.ndarray) -> None:
        if self.samples and t_us < self.samples[-1][0]:
            self.samples.clear()
        self.samples.append((t_us, gyr, acc))
        while len(self.samples) > self.size:
            self.samples.popleft()

    def solve(self, whole: bool = False) -> tuple[float, float, float] | None:
        """roll, pitch and the least sigma to start with (0 at rest); None with under three samples, or if a whole window is asked for and is not there."""
        if not self.samples:
            return None
        from_us = self.samples[-1][0] - self.window_s * 1e6
        if whole and len(self.samples) < self.size and self.samples[0][0] > from_us:
            return None
        own = [s for s in self.samples if s[0] >= from_us]
        if len(own) < 3:
            return None
        fx, fy, fz = np.median([s[2] for s in own], axis=0)
        rest = max(np.linalg.norm(s[1]) for s in own) <= self.still_gyr and abs((fx * fx + fy * fy + fz * fz) ** 0.5 - GRAVITY) <= self.still_acc
        return float(np.arctan2(-fy, -fz)), float(np.arctan2(fx, np.hypot(fy, fz))), 0.0 if rest else self.moving_sigma


def stillness_track(df: DataFrame, also: tuple[str, ...] = (), **settings: float) -> DataFrame:
    """recording_id, t_us, seq, `also`, active (rests), due (a standstill update is due) of an imu stream; a null speed is no speed."""

    def run(frame: pd.DataFrame, start: np.ndarray) -> dict[str, np.ndarray]:
        from driftline.operators.parts import Stills

        k, t, none = Stills(len(start), Still(**settings)), frame["t_us"].to_numpy(np.int64), np.zeros(3)
        g, a = frame[["gyr_x", "gyr_y", "gyr_z"]].to_numpy(float), frame[["acc_x", "acc_y", "acc_z"]].to_numpy(float)
        v = frame["speed"].to_numpy(float) if "speed" in frame else np.full(len(frame), np.nan)
        active, due = np.zeros(len(frame), bool), np.zeros(len(frame), bool)
        for j, i in steps(start, len(frame)):
            due[i] = k.step(j, t[i], g[i], a[i], none, v[i])
            active[i] = k.active[j]
        return {"active": active, "due": due}

    need = dict.fromkeys(("recording_id", "t_us", "seq", *also, "gyr_x", "gyr_y", "gyr_z", "acc_x", "acc_y", "acc_z", *(["speed"] if "speed" in df.columns else [])))
    return in_blocks(df.select(*need), run, "active boolean, due boolean", ("t_us", "seq", *also))


def level_track(df: DataFrame, window_s: float = 0.1, size: int = 64) -> DataFrame:
    """recording_id, t_us, seq, roll, pitch, sigma of the levelling window at each sample; null where it cannot be solved."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t_us", "seq"])
        k, out = LevelWindow(window_s, size), []
        g, a = frame[["gyr_x", "gyr_y", "gyr_z"]].to_numpy(float), frame[["acc_x", "acc_y", "acc_z"]].to_numpy(float)
        for i, t in enumerate(frame["t_us"]):
            k.push(int(t), g[i], a[i])
            out.append(k.solve() or (None, None, None))
        x = np.array(out, dtype=object)
        return frame[["recording_id", "t_us", "seq"]].assign(roll=x[:, 0], pitch=x[:, 1], sigma=x[:, 2]).astype({c: float for c in ("roll", "pitch", "sigma")})

    return per_recording(df, run, "roll double, pitch double, sigma double")
