"""The suite (operators/suite.py) for many recordings in one step: the same parts in the same order, with a leading axis of recordings."""

from __future__ import annotations

import numpy as np
import pandas as pd

from driftline.functions.atmosphere import HIGH, LOW
from driftline.operators.fleet import Fleet, columns, matrix, rpy, there
from driftline.operators.inertial import FIX, FIX_VAR, IMU, VEL, VEL_VAR, gravity
from driftline.operators.lockstep import steps
from driftline.operators.modes import COASTING, FULL
from driftline.operators.parts import ENTER, EVENT_NAMES, IMU_LOSS, NEVER, QUALITY_LOSS, REACQUIRE, Attitudes, Gates, Levels, Offsets, Stills, Verticals, never, since
from driftline.operators.suite import ACC_MOST, BARO_N, BARO_S, CARRY, GYR_MOST, LESS, MAG, USE, Suite, isa_height

#: Names of sources by number.
SOURCES = np.array([None, "ars", "ars_carried", "ahrs", "ins", "vertical", "offset"], object)
ARS, CARRIED, AHRS, INS, VERTICAL, OFFSET = range(1, 7)


def wrapped(a: np.ndarray) -> np.ndarray:
    return (a + np.pi) % (2 * np.pi) - np.pi


class Rows:
    """What the rows of a block offer; NaN where nothing."""

    def __init__(self, frame: pd.DataFrame) -> None:
        get = columns(frame)
        self.t_us = frame["t_us"].to_numpy(np.int64)
        imu, self.fix, self.fix_var, self.vel, self.vel_var, self.mag = (get(*names) for names in (IMU, FIX, FIX_VAR, VEL, VEL_VAR, MAG))
        self.gyr, self.acc = imu[:, :3], imu[:, 3:]
        self.yaw, self.yaw_var, self.pressure, age = get("yaw", "yaw_var", "pressure", "fix_age_s").T
        self.age_s = np.nan_to_num(age)
        self.sample = there(imu) & (np.abs(self.acc).max(1) <= ACC_MOST) & (np.abs(self.gyr).max(1) <= GYR_MOST)
        self.offered = there(self.fix) & (self.fix_var > 0).all(1)
        self.sigma = np.where(self.offered, np.sqrt(self.fix_var.max(1)), np.inf)
        self.moving, self.has_mag, self.has_yaw = there(self.vel) & there(self.vel_var), there(self.mag), ~(np.isnan(self.yaw) | np.isnan(self.yaw_var))
        self.speed = np.where(self.moving, np.linalg.norm(self.vel, axis=1), np.nan)
        self.plausible = (self.pressure >= LOW) & (self.pressure <= HIGH)
        self.height = isa_height(np.where(self.plausible, self.pressure, LOW))


class Suites:
    def __init__(self, n: int, rows: Rows, one: Suite) -> None:
        self.one, self.rows, self.arm = one, rows, np.array(one.arm, float)
        self.gate, self.still, self.level = Gates(n, one.gate), Stills(n, one.still), Levels(n, one.level)
        self.ins, self.ins_on = Fleet(n, lat=one.lat, height=one.origin_height), np.zeros(n, bool)
        self.ars, self.ahrs, self.vertical = Attitudes(n), Attitudes(n), Verticals(n, height_var=one.baro_var)
        self.offset, self.offset_on = Offsets(n, one.offset_walk, 0.0), np.zeros(n, bool)
        self.zero, self.shift, self.aligned, self.anchored = np.full(n, np.nan), np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
        self.boot_n, self.boot_sum, self.boot_at = np.zeros(n, int), np.zeros(n), never(n)
        self.biases, self.last_imu = np.full((n, 6), np.nan), never(n)
        self.carry, self.carry_at = np.zeros((n, 3)), never(n)  # yaw, the attitude filter's then, sigma

    # ---- the parts of an epoch; j: recordings, i: their rows

    def step(self, j: np.ndarray, i: np.ndarray) -> dict[str, np.ndarray]:
        m, t = self.rows, self.rows.t_us[i]
        entry = (m.sigma[i] <= self.one.entry_sigma) & (self.level.n[j] >= 3)
        entry[entry] = self.level.inside(j[entry])[1]
        event = self.gate.step(j, t, m.offered[i], entry, m.sigma[i] <= self.one.stay_sigma, m.sample[i])
        gone = j[(event == IMU_LOSS) | (event == QUALITY_LOSS)]
        had = gone[self.ins_on[gone]]
        self.biases[had] = np.concatenate([self.ins.ba[had], self.ins.bg[had]], 1)
        self.ins_on[gone] = False
        lost = j[m.sample[i] & (self.last_imu[j] != NEVER) & (since(t, self.last_imu[j]) > self.one.gate.imu_s * 1e6)]
        self.ars.on[lost] = self.ahrs.on[lost] = self.vertical.on[lost] = False  # the zero of heights stays
        self.boot_n[lost], self.boot_sum[lost], self.carry_at[lost], self.level.n[lost] = 0, 0.0, NEVER, 0
        self.position(j, i, event)
        self.align(j)
        own = m.offered[i]
        self.anchored[j[own]] = True
        self.local_offset(j[own], i[own])
        own = m.sample[i]
        if own.any():
            a, r, u = j[own], i[own], t[own]
            self.last_imu[a] = u
            self.level.push(a, u, m.gyr[r], m.acc[r])
            due = self.still.step(a, u, m.gyr[r], m.acc[r], np.where(self.ars.on[a][:, None], self.ars.bias[a], 0.0), m.speed[r])
            self.attitude(a, r, due)
            self.carried(a, u)
            self.height(a, r, due)
        return self.solution(j, t, event)

    def position(self, j: np.ndarray, i: np.ndarray, event: np.ndarray) -> None:
        m, one, ins = self.rows, self.one, self.ins
        enter = event == ENTER
        if enter.any():
            self.enter(j[enter], i[enter])
        own = ~enter & self.ins_on[j]
        again = own & (event == REACQUIRE)
        if again.any():
            a, r = j[again], i[again]
            yaw, yaw_sigma = self.first_yaw(a, r)
            moving = m.moving[r][:, None]
            l = matrix(ins.q[a]) @ self.arm
            ins.anchored(a, self.fix(a, r) - l, np.where(moving, m.vel[r], np.nan), m.fix_var[r], np.where(moving, m.vel_var[r], 1.0), (m.t_us[r] - ins.t_us[a]) / 1e6, np.where(yaw_sigma < np.pi, yaw, np.nan), yaw_sigma)
            ins.t_us[a] = m.t_us[r]
        own &= ~again & (self.gate.mode(j, m.t_us[i]) >= COASTING)  # else frozen: nothing is predicted until the next usable fix
        a, r = j[own], i[own]
        if not len(a):
            return
        s = m.sample[r]
        ins.predict(a[s], m.t_us[r[s]], m.gyr[r[s]], m.acc[r[s]])
        s = m.offered[r] & (m.sigma[r] <= one.stay_sigma)
        ins.position(a[s], self.fix(a[s], r[s]), m.fix_var[r[s]], self.arm, m.age_s[r[s]])
        s &= m.moving[r]
        ins.velocity(a[s], m.vel[r[s]], m.vel_var[r[s]], self.arm, m.age_s[r[s]])
        s = m.has_yaw[r]
        ins.yaw(a[s], m.yaw[r[s]], m.yaw_var[r[s]], np.zeros(int(s.sum())))
        ins.standstill(a[self.still.active[a]], 0.05)
        s = ~np.isnan(self.zero[a]) & m.plausible[r]
        ins.baro(a[s], m.height[r[s]] - self.zero[a[s]], one.baro_var)
        d = np.diagonal(ins.cov[a], axis1=1, axis2=2)
        sound = np.isfinite(np.concatenate([ins.p[a], ins.v[a], ins.q[a], ins.ba[a], ins.bg[a]], 1)).all(1) & np.isfinite(ins.cov[a]).all((1, 2)) & (d > 0).all(1) & (d < 1e12).all(1)
        self.ins_on[a[~sound]] = False
        self.gate.stopped(a[~sound])

    def fix(self, j: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.rows.fix[i] - self.shift[j][:, None] * np.array([0, 0, 1.0])

    def enter(self, j: np.ndarray, i: np.ndarray) -> None:
        m, ins = self.rows, self.ins
        _, roll, pitch, sigma = self.level.solve(j)
        yaw, yaw_sigma = self.first_yaw(j, i)
        ins.anew(j)
        ins.level(j, np.stack([np.sin(pitch), -np.sin(roll) * np.cos(pitch), -np.cos(roll) * np.cos(pitch)], 1), yaw)
        known = ~np.isnan(self.biases[j]).all(1)[:, None]
        ins.ba[j] = np.where(known, self.biases[j, :3], 0.0)
        ins.bg[j] = np.where(known, self.biases[j, 3:], np.where(self.ars.on[j][:, None], self.ars.bias[j], 0.0))
        moving = m.moving[i][:, None]
        var = np.diagonal(ins.cov[j], axis1=1, axis2=2).copy()
        var[:, :3], var[:, 3:6] = m.fix_var[i], np.where(moving, m.vel_var[i], 1.0)
        var[:, 6], var[:, 8] = np.maximum(sigma, np.radians(2.0)) ** 2, yaw_sigma**2
        var[:, 7] = var[:, 6]
        l = matrix(ins.q[j]) @ self.arm
        l[:, :2] *= (yaw_sigma < 1.0)[:, None]  # the horizontal arm needs a yaw
        ins.cov[j], ins.p[j], ins.v[j] = var[:, :, None] * np.eye(15), self.fix(j, i) - l, np.where(moving, m.vel[i], 0.0)
        ins.t_us[j], ins.begun[j], self.ins_on[j] = m.t_us[i], True, True

    def first_yaw(self, j: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.rows
        held, held_sigma = self.held_yaw(j, m.t_us[i])
        has, kept, field = m.has_yaw[i], ~np.isnan(held), self.ahrs.on[j]
        yaw = np.where(has, m.yaw[i], np.where(kept, held, np.where(field, rpy(self.ahrs.q[j])[:, 2], 0.0)))
        return yaw, np.where(has, np.sqrt(m.yaw_var[i]), np.where(kept, held_sigma, np.where(field, LESS * np.sqrt(self.ahrs.p[j, 2, 2]), np.pi)))

    def align(self, j: np.ndarray) -> None:
        j = j[~self.aligned[j] & self.ins_on[j]]
        self.aligned[j] = True
        j = j[self.vertical.on[j]]
        dz = self.vertical.x[j, 0] + self.ins.p[j, 2]
        self.ins.p[j, 2] -= dz
        self.shift[j] += dz
        self.ins.height[j] -= dz
        self.ins.size[j] = 0

    def local_offset(self, j: np.ndarray, i: np.ndarray) -> None:
        m, up = self.rows, self.vertical.on[j]
        go = up | (self.ins_on[j] & (self.gate.mode(j, m.t_us[i]) >= COASTING))
        j, i, up = j[go], i[go], up[go]
        if not len(j):
            return
        h, climb = np.where(up, self.vertical.x[j, 0], -self.ins.p[j, 2]), np.where(up, self.vertical.x[j, 1], -self.ins.v[j, 2])
        z = self.one.origin_height - m.fix[i, 2] + (self.best(j, self.ins_on[j]) @ self.arm)[:, 2] - (h - climb * np.maximum(m.age_s[i], 0.0))
        new = j[~self.offset_on[j]]
        self.offset.noise_var[new] = m.fix_var[i[~self.offset_on[j]], 2] + self.one.baro_var
        self.offset_on[j] = True
        self.offset.step(j, m.t_us[i], z)

    def best(self, j: np.ndarray, ins: np.ndarray) -> np.ndarray:
        """Matrices of the inertial filter where `ins`, else of the attitude filter with a magnetometer, else of the other; zero where there is none."""
        q = np.where(ins[:, None], self.ins.q[j], np.where(self.ahrs.on[j][:, None], self.ahrs.q[j], self.ars.q[j]))
        return matrix(q) * (ins | self.ahrs.on[j] | self.ars.on[j])[:, None, None]

    def attitude(self, j: np.ndarray, i: np.ndarray, due: np.ndarray) -> None:
        m, one = self.rows, self.one
        mean = self.still.gyr_mean(j[due])
        resting = np.full((len(j), 3), np.nan)
        resting[due] = mean
        for k in (self.ars, self.ahrs):
            field = m.has_mag[i]
            on, want = k.on[j].copy(), ~k.on[j] & (field if k is self.ahrs else True)
            a, r = j[want], i[want]
            if len(a):
                enough, roll, pitch, sigma = self.level.solve(a, whole=True)
                a, r = a[enough], r[enough]
                k.begin(a, m.t_us[r], roll[enough], pitch[enough], sigma[enough])
                if k is self.ahrs:
                    k.p[a, 2, 2] = np.pi**2
                    k.magnetic(a, m.mag[r], one.mag_var, one.declination)
                else:
                    self.carry_at[a] = NEVER  # its yaw starts anew
            k.step(j[on], m.t_us[i[on]], m.gyr[i[on]], m.acc[i[on]])
            if k is self.ahrs:
                k.magnetic(j[on & field], m.mag[i[on & field]], one.mag_var, one.declination)
            k.rest(j[on & due], resting[on & due])

    def carried(self, j: np.ndarray, t: np.ndarray) -> None:
        sigma = np.sqrt(self.ins.cov[j, 8, 8])
        own = self.ins_on[j] & self.ars.on[j] & (self.gate.mode(j, t) >= COASTING) & (sigma > 0) & (sigma <= CARRY)
        j = j[own]
        self.carry[j] = np.stack([rpy(self.ins.q[j])[:, 2], rpy(self.ars.q[j])[:, 2], sigma[own]], 1)
        self.carry_at[j] = t[own]

    def held_yaw(self, j: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last good yaw, carried on, and its sigma; NaN where it is of no use."""
        yaw, then, sigma = self.carry[j].T
        known = (self.carry_at[j] != NEVER) & self.ars.on[j]
        drift = LESS * np.sqrt(self.ars.p[j, 5, 5]) * np.maximum(t - np.where(known, self.carry_at[j], t), 0) / 1e6
        total = np.hypot(sigma, drift)
        return np.where(known & (total <= USE), wrapped(yaw + rpy(self.ars.q[j])[:, 2] - then), np.nan), total

    def height(self, j: np.ndarray, i: np.ndarray, due: np.ndarray) -> None:
        m, one, k = self.rows, self.one, self.vertical
        ins = self.ins_on[j] & (self.gate.mode(j, m.t_us[i]) >= COASTING)
        some = ins | self.ahrs.on[j] | self.ars.on[j]
        on = some & k.on[j]
        own = some & ~k.on[j]
        a, r = j[own & m.plausible[i]], i[own & m.plausible[i]]
        self.boot_at[a] = np.where(self.boot_n[a] == 0, m.t_us[r], self.boot_at[a])
        self.boot_sum[a] += m.height[r]
        self.boot_n[a] += 1
        a, t = j[own], m.t_us[i[own]]
        ready = (self.boot_n[a] >= BARO_N) & (since(t, self.boot_at[a]) >= BARO_S * 1e6)
        a, t = a[ready], t[ready]
        mean = self.boot_sum[a] / self.boot_n[a]
        self.zero[a] = np.where(np.isnan(self.zero[a]), mean + np.where(self.ins_on[a], self.ins.p[a, 2], 0.0), self.zero[a])
        k.begin(a, t, mean - self.zero[a])
        self.boot_n[a], self.boot_sum[a] = 0, 0.0
        a, r = j[on], i[on]
        if len(a):
            down = np.einsum("nj,nj->n", self.best(a, ins[on])[:, 2], m.acc[r])
            k.predict(a, m.t_us[r], -(down + gravity(one.lat, one.origin_height)))
            s = m.plausible[r]
            k.height(a[s], m.height[r[s]] - self.zero[a[s]])
            k.standstill(a[due[on]], 0.05)

    # ---- what it says

    def solution(self, j: np.ndarray, t: np.ndarray, event: np.ndarray) -> dict[str, np.ndarray]:
        mode = self.gate.mode(j, t, self.ars.on[j] | self.ahrs.on[j])
        ready = self.ins_on[j] & (mode >= COASTING)
        only = lambda where, x: np.where(where, x, np.nan)
        source = np.where(ready, INS, np.where(self.ahrs.on[j], AHRS, np.where(self.ars.on[j], ARS, 0)))
        q = np.where((source == INS)[:, None], self.ins.q[j], np.where((source == AHRS)[:, None], self.ahrs.q[j], self.ars.q[j]))
        roll, pitch, yaw = (only(source > 0, x) for x in rpy(q).T)
        held, _ = self.held_yaw(j, t)
        carries = (source == ARS) & ~np.isnan(held)
        local = self.ins.p[j] + self.shift[j][:, None] * np.array([0, 0, 1.0])
        full, up = ready & (mode == FULL), self.vertical.on[j]
        by_ins = full | (ready & ~up)
        height = only(by_ins | up, np.where(by_ins, -self.ins.p[j, 2], self.vertical.x[j, 0]))
        direct = full & self.anchored[j]
        by_offset = ~direct & self.offset_on[j] & ~np.isnan(height)
        placed = direct | (~by_offset & ready & self.anchored[j])
        return {
            "mode": mode, "event": event, "attitude_source": np.where(carries, CARRIED, source), "height_source": np.where(by_ins, INS, np.where(up, VERTICAL, 0)),
            "ellipsoid_source": np.where(placed, INS, np.where(by_offset, OFFSET, 0)), "roll": roll, "pitch": pitch, "yaw": np.where(carries, held, yaw), "height": height,
            "ellipsoid": only(placed | by_offset, np.where(placed, self.one.origin_height - local[:, 2], height + self.offset.value[j])),
            **{c: only(ready, local[:, k]) for k, c in enumerate("ned")}, **{f"v{c}": only(ready, self.ins.v[j, k]) for k, c in enumerate("ned")},
        }


def tracked(frame: pd.DataFrame, start: np.ndarray, one: Suite) -> dict[str, np.ndarray]:
    """`suite.suite_track` over a block of recordings."""
    k, out = Suites(len(start), Rows(frame), one), {}
    for j, i in steps(start, len(frame)):
        for c, x in k.step(j, i).items():
            out.setdefault(c, np.empty(len(frame), x.dtype))[i] = x
    out["event"] = EVENT_NAMES[out["event"]]
    return out | {c: SOURCES[out[c]] for c in ("attitude_source", "height_source", "ellipsoid_source")}
