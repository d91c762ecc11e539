"""The mode of a solution over epochs: entry dwell, stay, loss of quality or of samples, coasting, re-acquisition.

`Gate` remembers what a single epoch's gates (operators/gates.py) cannot: how long
good aiding has come, how much bad aiding has come, and when the last sample and
the last used aiding came. It takes plain values, so that a recording, the batches
of a stream and the suite step through the same code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from driftline.operators.lockstep import in_blocks, steps

NONE, ATTITUDE, COASTING, FULL = range(4)


@dataclass
class Gate:
    """Seconds: good aiding before entry, its longest gap, bad aiding before the solution is given up, most that one epoch
    of it counts, unaided time before the solution freezes, age of aiding in full mode, longest gap of samples."""

    dwell_s: float = 5.0
    gap_s: float = 2.0
    stop_s: float = 10.0
    stop_step_s: float = 2.0
    coast_s: float = 10.0
    fresh_s: float = 2.0
    imu_s: float = 0.2
    least_hz: float = 1.0
    running: bool = False
    since: int | None = None
    last: int | None = None
    count: int = 0
    bad_s: float = 0.0
    bad_last: int | None = None
    used: int | None = None
    imu: int | None = None

    def stopped(self) -> None:
        self.running, self.since, self.last, self.count, self.bad_s, self.bad_last = False, None, None, 0, 0.0, None

    def dwell(self, t_us: int, entry: bool) -> bool:
        """Whether good aiding has come long and often enough."""
        if not entry:
            self.since, self.last, self.count = None, None, 0
            return False
        if self.since is None or t_us < self.last or t_us - self.last > self.gap_s * 1e6:
            self.since, self.count = t_us, 0
        self.last, self.count = t_us, self.count + 1
        return t_us - self.since >= self.dwell_s * 1e6 and self.count >= int(self.dwell_s * self.least_hz + 0.5)

    def step(self, t_us: int, offered: bool, entry: bool, stay: bool, sample: bool = True) -> str | None:
        """What happens at this epoch: imu_loss, enter, quality_loss, reacquire, or nothing.

        offered: whether it brings position aiding; entry, stay: what the gates say of it; sample: whether it is an inertial one.
        """
        event = None
        if self.running and self.imu is not None and t_us - self.imu > self.imu_s * 1e6:
            self.stopped()
            event = "imu_loss"
        if sample:
            self.imu = t_us
        if not offered:
            return event
        if not self.running:
            if self.dwell(t_us, entry):
                self.running, self.used, self.bad_s, self.bad_last, event = True, t_us, 0.0, None, "enter"
            return event
        if stay:
            event = "reacquire" if t_us - self.used > self.coast_s * 1e6 else event
            self.used, self.bad_s, self.bad_last = t_us, 0.0, None
        elif self.bad_last is None or t_us < self.bad_last:
            self.bad_s, self.bad_last = 0.0, t_us
        else:
            # Only epochs with aiding count, so that an outage between two bad ones does not fill the time.
            self.bad_s, self.bad_last = self.bad_s + min((t_us - self.bad_last) / 1e6, self.stop_step_s), t_us
            if self.bad_s >= self.stop_s:
                self.stopped()
                event = "quality_loss"
        return event

    def age_s(self, t_us: int) -> float:
        """Seconds without aiding of a running solution."""
        return (t_us - self.used) / 1e6 if self.running else np.inf

    def mode(self, t_us: int, attitude: bool = True) -> int:
        age = self.age_s(t_us)
        return FULL if age <= self.fresh_s else COASTING if age <= self.coast_s else ATTITUDE if attitude else NONE


def mode_track(df: DataFrame, **settings: float) -> DataFrame:
    """recording_id, t_us, seq, event, mode for rows with offered, entry, stay and sample (booleans)."""

    def run(frame: pd.DataFrame, start: np.ndarray) -> dict[str, np.ndarray]:
        from driftline.operators.parts import EVENT_NAMES, Gates

        k, t = Gates(len(start), Gate(**settings)), frame["t_us"].to_numpy(np.int64)
        flags, event, mode = frame[["offered", "entry", "stay", "sample"]].to_numpy(bool), np.zeros(len(frame), int), np.zeros(len(frame), int)
        for j, i in steps(start, len(frame)):
            event[i] = k.step(j, t[i], *flags[i].T)
            mode[i] = k.mode(j, t[i])
        return {"event": EVENT_NAMES[event], "mode": mode}

    return in_blocks(df.select("recording_id", "t_us", "seq", "offered", "entry", "stay", "sample"), run, "event string, mode int")


def inflated(var: np.ndarray, psd: np.ndarray, seconds: float | np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Variances after a time in which nothing was predicted: they grow with the noise, up to what a cold start has."""
    return np.where(var < cap, np.minimum(var + psd * np.maximum(seconds, 0.0), cap), var)


def healthy(x: np.ndarray, cov: np.ndarray, limit: float = 1e12) -> bool:
    """Whether state and covariance are finite and the variances positive."""
    d = np.diagonal(cov)
    return bool(np.isfinite(x).all() and np.isfinite(cov).all() and (d > 0).all() and (d < limit).all())


#: Standard deviations of position, velocity and attitude (degrees) that no real solution gets below.
LEAST_SIGMA = (1e-4, 1e-4, 1e-3)


def overconfident(cov: np.ndarray) -> bool:
    """Whether a variance of position, velocity or attitude is too small to be believed; negative ones are not."""
    d = np.diagonal(cov)[:9].reshape(3, 3).min(1)
    return bool(((d >= 0) & (d < np.array([LEAST_SIGMA[0] ** 2, LEAST_SIGMA[1] ** 2, np.radians(LEAST_SIGMA[2]) ** 2]))).any())
