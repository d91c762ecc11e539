"""Four filters in one pass, and which of them speaks.

A position filter (operators/inertial.py), an attitude filter without and one with
a magnetometer, and a vertical filter on pressure run over the same samples; a
fifth state is the offset between local and ellipsoidal heights. The gate of
operators/modes.py decides when the position filter starts, freezes, is anchored
again or given up. An epoch goes through them in fixed order: position filter,
common zero of heights, offset, attitude, carried yaw, vertical filter.

Sources by mode: attitude from the position filter while it runs, else from the
magnetometer's filter, else from the other one with the last good yaw carried on by
its rotation; heights from the position filter in full mode, else from the vertical
one; ellipsoidal heights likewise, with the offset added to local heights.

Positions are north, east, down of an origin at a known latitude and ellipsoidal
height.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from driftline.functions.atmosphere import EXPONENT, HIGH, LOW, P0, SCALE
from driftline.operators.filters import Attitude, Offset, Vertical
from driftline.operators.inertial import FIX, FIX_VAR, IMU, VEL, VEL_VAR, History, Inertial, gravity
from driftline.operators.lockstep import in_blocks
from driftline.operators.modes import COASTING, FULL, Gate, healthy
from driftline.operators.stillness import LevelWindow, Still

MAG = ["mag_x", "mag_y", "mag_z"]
#: Yaw sigmas up to which a yaw is worth carrying and worth using; how much less an attitude filter's sigma
#: counts for another filter; samples of pressure and seconds that set the zero of heights; what no sensor can have shown.
CARRY, USE, LESS, BARO_N, BARO_S, ACC_MOST, GYR_MOST = np.radians(15.0), np.radians(30.0), 10.0, 2, 0.3, 500.0, 100.0
EVENTS = ("imu_loss", "enter", "quality_loss", "reacquire")


def isa_height(pressure: float) -> float:
    return SCALE * (1 - (pressure / P0) ** EXPONENT)


def wrapped(a: float) -> float:
    return float((a + np.pi) % (2 * np.pi) - np.pi)


@dataclass
class Epoch:
    """What a row offers; NaN where nothing."""

    t_us: int
    gyr: np.ndarray
    acc: np.ndarray
    fix: np.ndarray
    fix_var: np.ndarray
    vel: np.ndarray
    vel_var: np.ndarray
    fix_age_s: float = 0.0
    pressure: float = np.nan
    mag: np.ndarray = field(default_factory=lambda: np.full(3, np.nan))
    yaw: float = np.nan
    yaw_var: float = np.nan


@dataclass
class Suite:
    lat: float = 0.8
    origin_height: float = 0.0
    arm: tuple = (0.0, 0.0, 0.0)
    entry_sigma: float = 5.0
    stay_sigma: float = 15.0
    declination: float = 0.0
    mag_var: float = np.radians(5.0) ** 2
    baro_var: float = 1.0
    offset_walk: float = 1e-3
    gate: Gate = field(default_factory=Gate)
    still: Still = field(default_factory=Still)
    level: LevelWindow = field(default_factory=LevelWindow)
    ins: Inertial | None = None
    ars: Attitude | None = None
    ahrs: Attitude | None = None
    vertical: Vertical | None = None
    offset: Offset | None = None
    zero: float | None = None  # pressure height at local height 0
    boot: list = field(default_factory=list)
    shift: float = 0.0  # what the origin went down by to meet the vertical filter's zero
    aligned: bool = False
    biases: np.ndarray | None = None
    carry: tuple[float, float, float, int] | None = None
    yaw_known: bool = False
    last_imu: int | None = None
    anchored: bool = False

    # ---- the parts of an epoch

    def step(self, m: Epoch) -> dict:
        there = lambda *xs: not any(np.isnan(x).any() for x in xs)
        sample = there(m.gyr, m.acc) and np.abs(m.acc).max() <= ACC_MOST and np.abs(m.gyr).max() <= GYR_MOST
        offered = there(m.fix, m.fix_var) and bool((m.fix_var > 0).all())
        sigma = float(np.sqrt(m.fix_var.max())) if offered else np.inf
        event = self.gate.step(m.t_us, offered, sigma <= self.entry_sigma and self.level.solve() is not None, sigma <= self.stay_sigma, sample)
        if event in ("imu_loss", "quality_loss"):
            self.biases = np.concatenate([self.ins.ba, self.ins.bg]) if self.ins else self.biases
            self.ins = None
        if sample and self.last_imu is not None and m.t_us - self.last_imu > self.gate.imu_s * 1e6:
            self.ars = self.ahrs = self.vertical = None  # the zero of heights stays
            self.boot, self.carry, self.level = [], None, replace(self.level, samples=deque())
        self.position(m, event, sample, offered)
        self.align()
        if offered:
            self.anchored = True
            self.local_offset(m)
        if sample:
            self.last_imu = m.t_us
            self.level.push(m.t_us, m.gyr, m.acc)
            due = self.still.step(m.t_us, m.gyr, m.acc, self.ars.bias if self.ars else np.zeros(3), speed=float(np.linalg.norm(m.vel)) if there(m.vel, m.vel_var) else None)
            self.attitude(m, self.still.gyr_mean() if due else None)
            self.carried(m.t_us)
            self.height(m, due)
        return self.solution(m.t_us, event)

    def position(self, m: Epoch, event: str | None, sample: bool, offered: bool) -> None:
        fix = m.fix - np.array([0, 0, self.shift])
        arm = np.array(self.arm, float)
        moving = not np.isnan(m.vel).any() and not np.isnan(m.vel_var).any()
        if event == "enter":
            roll, pitch, sigma = self.level.solve()
            yaw, yaw_sigma = self.first_yaw(m)
            k = Inertial(lat=self.lat, height=self.origin_height)
            k.level(np.array([np.sin(pitch), -np.sin(roll) * np.cos(pitch), -np.cos(roll) * np.cos(pitch)]), yaw)
            if self.biases is not None:
                k.ba, k.bg = self.biases[:3].copy(), self.biases[3:].copy()
            elif self.ars:
                k.bg = self.ars.bias.copy()
            least = max(sigma, np.radians(2.0))
            var = np.diagonal(k.cov).copy()
            var[:3], var[3:6], var[6:9] = m.fix_var, m.vel_var if moving else 1.0, [least**2, least**2, yaw_sigma**2]
            l = k.matrix() @ arm
            l[:2] *= yaw_sigma < 1.0  # the horizontal arm needs a yaw
            k.cov, k.p, k.v = np.diag(var), fix - l, m.vel.copy() if moving else np.zeros(3)
            k.t_us = m.t_us
            self.ins, self.yaw_known = k, yaw_sigma < 1.0
            return
        if self.ins is None:
            return
        if event == "reacquire":
            yaw, yaw_sigma = self.first_yaw(m)
            l = self.ins.matrix() @ arm
            self.ins.anchored(fix - l, m.vel if moving else None, m.fix_var, m.vel_var if moving else np.full(3, 1.0), (m.t_us - self.ins.t_us) / 1e6, yaw if yaw_sigma < np.pi else None, yaw_sigma)
            self.ins.t_us = m.t_us
            return
        if self.gate.mode(m.t_us) < COASTING:
            return  # frozen: nothing is predicted until the next usable fix
        if sample:
            self.ins.predict(m.t_us, m.gyr, m.acc)
        if self.ins.t_us is None:
            return
        if offered and np.sqrt(m.fix_var.max()) <= self.stay_sigma:
            self.ins.position(fix, m.fix_var, arm, m.fix_age_s)
            if moving:
                self.ins.velocity(m.vel, m.vel_var, arm, m.fix_age_s)
        if not (np.isnan(m.yaw) or np.isnan(m.yaw_var)):
            self.ins.yaw(m.yaw, m.yaw_var)
        if self.still.active:
            self.ins.standstill(0.05)
        if self.zero is not None and LOW <= m.pressure <= HIGH:
            self.ins.baro(isa_height(m.pressure) - self.zero, self.baro_var)
        if not healthy(np.concatenate([self.ins.p, self.ins.v, self.ins.q, self.ins.ba, self.ins.bg]), self.ins.cov):
            self.ins = None
            self.gate.stopped()

    def first_yaw(self, m: Epoch) -> tuple[float, float]:
        """A yaw to start with and its sigma: measured, carried on, by magnetometer, or unknown."""
        if not (np.isnan(m.yaw) or np.isnan(m.yaw_var)):
            return m.yaw, float(np.sqrt(m.yaw_var))
        if (held := self.held_yaw(m.t_us)) is not None:
            return held
        if self.ahrs:
            return float(self.ahrs.rpy()[2]), LESS * float(np.sqrt(self.ahrs.p[2, 2]))
        return 0.0, np.pi

    def align(self) -> None:
        """The first of both to start owns height 0: the position filter's origin moves to the vertical filter's zero, once."""
        if self.aligned or self.ins is None:
            return
        if self.vertical is not None:
            dz = float(self.vertical.x[0] + self.ins.p[2])
            self.ins.p = self.ins.p - np.array([0, 0, dz])
            self.shift, self.ins.height = self.shift + dz, self.ins.height - dz
            self.ins.history = History()
        self.aligned = True

    def local_offset(self, m: Epoch) -> None:
        """Feeds the offset with a fix's ellipsoidal height at the sensor and the local height at the same time."""
        if self.vertical is not None:
            h, climb = self.vertical.x[0], self.vertical.x[1]
        elif self.ins is not None and self.gate.mode(m.t_us) >= COASTING:
            h, climb = -self.ins.p[2], -self.ins.v[2]
        else:
            return
        best = self.ins or self.ahrs or self.ars
        down = float((best.matrix() @ np.array(self.arm, float))[2]) if best else 0.0
        z = self.origin_height - m.fix[2] + down - (h - climb * max(m.fix_age_s, 0.0))
        if self.offset is None:
            self.offset = Offset(self.offset_walk, float(m.fix_var[2]) + self.baro_var)
        self.offset.step(m.t_us, float(z))

    def attitude(self, m: Epoch, gyr_mean: np.ndarray | None) -> None:
        has_mag = not np.isnan(m.mag).any()
        for name in ("ars", "ahrs"):
            k = getattr(self, name)
            if k is None:
                level = self.level.solve(whole=True)
                if level is None or (name == "ahrs" and not has_mag):
                    continue
                roll, pitch, sigma = level
                k = Attitude()
                k.q = k.product(k.exponential(np.array([0, pitch, 0])), k.exponential(np.array([roll, 0, 0])))
                k.p[:2, :2] = np.eye(2) * max(np.radians(10.0), sigma) ** 2
                k.t_us = m.t_us
                if name == "ahrs":
                    k.p[2, 2] = np.pi**2
                    k.magnetic(m.mag, self.mag_var, self.declination)
                else:
                    self.carry = None  # its yaw starts anew
                setattr(self, name, k)
                continue
            k.step(m.t_us, m.gyr, m.acc)
            if name == "ahrs" and has_mag:
                k.magnetic(m.mag, self.mag_var, self.declination)
            if gyr_mean is not None:
                k.rest(gyr_mean)

    def carried(self, t_us: int) -> None:
        if self.ins is not None and self.ars is not None and self.gate.mode(t_us) >= COASTING:
            sigma = float(np.sqrt(self.ins.cov[8, 8]))
            if 0 < sigma <= CARRY:
                self.carry = (float(self.ins.rpy()[2]), float(self.ars.rpy()[2]), sigma, t_us)

    def held_yaw(self, t_us: int) -> tuple[float, float] | None:
        """The last good yaw, carried on by what the attitude filter has turned since, until its drift has made it useless."""
        if self.carry is None or self.ars is None:
            return None
        yaw, then, sigma, at = self.carry
        drift = LESS * float(np.sqrt(self.ars.p[5, 5])) * max(t_us - at, 0) / 1e6
        total = float(np.hypot(sigma, drift))
        return (wrapped(yaw + self.ars.rpy()[2] - then), total) if total <= USE else None

    def height(self, m: Epoch, due: bool) -> None:
        best = self.ins if self.ins is not None and self.gate.mode(m.t_us) >= COASTING else self.ahrs or self.ars
        if best is None:
            return
        plausible = LOW <= m.pressure <= HIGH
        if self.vertical is None:
            if plausible:
                self.boot.append((m.t_us, isa_height(m.pressure)))
            if len(self.boot) >= BARO_N and m.t_us - self.boot[0][0] >= BARO_S * 1e6:
                mean = float(np.mean([h for _, h in self.boot]))
                if self.zero is None:
                    self.zero = mean - (-self.ins.p[2] if self.ins is not None else 0.0)
                self.vertical = Vertical(height_var=self.baro_var)
                self.vertical.x[0], self.vertical.t_us, self.boot = mean - self.zero, m.t_us, []
            return
        self.vertical.predict(m.t_us, -float((best.matrix() @ m.acc)[2] + gravity(self.lat, self.origin_height)))
        if plausible:
            self.vertical.height(isa_height(m.pressure) - self.zero)
        if due:
            self.vertical.standstill(0.05)

    # ---- what it says

    def solution(self, t_us: int, event: str | None) -> dict:
        mode = self.gate.mode(t_us, self.ars is not None or self.ahrs is not None)
        ready = self.ins is not None and mode >= COASTING
        out = {"mode": mode, "event": event, "attitude_source": None, "height_source": None, "ellipsoid_source": None}
        out |= dict.fromkeys(("roll", "pitch", "yaw", "height", "ellipsoid", "n", "e", "d", "vn", "ve", "vd"), np.nan)
        source = "ins" if ready else "ahrs" if self.ahrs else "ars" if self.ars else None
        if source:
            out["roll"], out["pitch"], out["yaw"] = getattr(self, source).rpy()
            held = self.held_yaw(t_us) if source == "ars" else None
            out["attitude_source"], out["yaw"] = ("ars_carried", held[0]) if held else (source, out["yaw"])
        if ready:
            out["n"], out["e"], out["d"] = self.ins.p + np.array([0, 0, self.shift])
            out["vn"], out["ve"], out["vd"] = self.ins.v
        if ready and mode == FULL:
            out["height_source"], out["height"] = "ins", -self.ins.p[2]
        elif self.vertical is not None:
            out["height_source"], out["height"] = "vertical", self.vertical.x[0]
        elif ready:
            out["height_source"], out["height"] = "ins", -self.ins.p[2]
        if ready and mode == FULL and self.anchored:
            out["ellipsoid_source"], out["ellipsoid"] = "ins", self.origin_height - out["d"]
        elif self.offset is not None and not np.isnan(out["height"]):
            out["ellipsoid_source"], out["ellipsoid"] = "offset", out["height"] + self.offset.value
        elif ready and self.anchored:
            out["ellipsoid_source"], out["ellipsoid"] = "ins", self.origin_height - out["d"]
        return out


OUT = "mode int, event string, attitude_source string, height_source string, ellipsoid_source string, roll double, pitch double, yaw double, height double, ellipsoid double, n double, e double, d double, vn double, ve double, vd double"


def epochs(frame: pd.DataFrame):
    """The rows of a frame, in order of time, as epochs."""
    col = {c: frame[c].to_numpy(float) for c in [*IMU, *FIX, *FIX_VAR, *VEL, *VEL_VAR, *MAG, "fix_age_s", "pressure", "yaw", "yaw_var"] if c in frame}
    get = lambda i, names: np.array([col[c][i] if c in col else np.nan for c in names])
    for i, t in enumerate(frame["t_us"]):
        yield Epoch(int(t), get(i, IMU[:3]), get(i, IMU[3:]), get(i, FIX), get(i, FIX_VAR), get(i, VEL), get(i, VEL_VAR), float(np.nan_to_num(get(i, ["fix_age_s"])[0])), get(i, ["pressure"])[0], get(i, MAG), *get(i, ["yaw", "yaw_var"]))


def suite_track(df: DataFrame, gate: dict | None = None, still: dict | None = None, level: dict | None = None, **settings) -> DataFrame:
    """Mode, event, sources, attitude, heights and position for each row of aligned streams.

    Rows have recording_id, t_us, seq and the columns IMU (null: no sample), and may have FIX, FIX_VAR, VEL, VEL_VAR, fix_age_s,
    pressure (Pa), MAG, yaw and yaw_var. gate, still, level: settings of the parts.
    """

    from driftline.operators.suites import tracked

    one = Suite(gate=Gate(**gate or {}), still=Still(**still or {}), level=LevelWindow(**level or {}), **settings)
    return in_blocks(df, lambda frame, start: tracked(frame, start, one), OUT)
