"""Inertial filters of many recordings in one step: what `inertial.Inertial` does, with a leading axis of recordings.

Every method takes the numbers `j` of the recordings it steps, and values with a row for each of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from driftline.functions.geo import A, E2, OMEGA_E
from driftline.operators.inertial import BA, BG, FIX, FIX_COV, FIX_VAR, IMU, NEAR_US, OLDEST_S, RING, RING_US, SPAN_US, VEL, VEL_VAR, Inertial, P, T, V, gravity
from driftline.operators.lockstep import steps
from driftline.operators.modes import inflated


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quaternions [..., 4]."""
    aw, ax, ay, az = np.moveaxis(a, -1, 0)
    bw, bx, by, bz = np.moveaxis(b, -1, 0)
    return np.stack([aw * bw - ax * bx - ay * by - az * bz, aw * bx + bw * ax + ay * bz - az * by, aw * by + bw * ay + az * bx - ax * bz, aw * bz + bw * az + ax * by - ay * bx], -1)


def exponential(v: np.ndarray) -> np.ndarray:
    a = np.sqrt((v * v).sum(-1))
    some = a > 1e-9
    return np.concatenate([np.cos(a / 2)[..., None], v * np.where(some, np.sin(a / 2) / np.where(some, a, 1.0), 0.5)[..., None]], -1)


def unit(q: np.ndarray) -> np.ndarray:
    return q / np.sqrt((q * q).sum(-1))[..., None]


def matrix(q: np.ndarray) -> np.ndarray:
    w, x, y, z = np.moveaxis(q, -1, 0)
    r = np.empty((*q.shape[:-1], 3, 3))
    r[..., 0, 0], r[..., 0, 1], r[..., 0, 2] = 1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)
    r[..., 1, 0], r[..., 1, 1], r[..., 1, 2] = 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)
    r[..., 2, 0], r[..., 2, 1], r[..., 2, 2] = 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)
    return r


def rpy(q: np.ndarray) -> np.ndarray:
    r = matrix(q)
    return np.stack([np.arctan2(r[..., 2, 1], r[..., 2, 2]), np.arcsin(np.clip(-r[..., 2, 0], -1, 1)), np.arctan2(r[..., 1, 0], r[..., 0, 0])], -1)


def levelled(roll: np.ndarray, pitch: np.ndarray) -> np.ndarray:
    o = np.zeros_like(roll)
    return product(exponential(np.stack([o, pitch, o], -1)), exponential(np.stack([roll, o, o], -1)))


def skew(v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(v), 3, 3))
    out[:, 0, 1], out[:, 0, 2], out[:, 1, 0], out[:, 1, 2], out[:, 2, 0], out[:, 2, 1] = -v[:, 2], v[:, 1], v[:, 2], -v[:, 0], -v[:, 1], v[:, 0]
    return out


def turned(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Matrices times vectors."""
    return np.einsum("nij,nj->ni", m, v)


def gained(cov: np.ndarray, h: np.ndarray, k: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Covariances after a scalar row, in Joseph's form."""
    m = np.eye(h.shape[1]) - k[:, :, None] * h[:, None, :]
    return m @ cov @ m.transpose(0, 2, 1) + k[:, :, None] * k[:, None, :] * var[:, None, None]


def row(m: int, n: int = 15, **parts: np.ndarray) -> np.ndarray:
    h = np.zeros((m, n))
    for name, x in parts.items():
        h[:, {"p": P, "v": V, "t": T, "ba": BA, "bg": BG}[name]] = x
    return h


def there(x: np.ndarray) -> np.ndarray:
    return ~np.isnan(x).any(1)


class Fleet:
    def __init__(self, n: int, **settings) -> None:
        self.one = one = Inertial(**settings)
        self.p, self.v, self.q, self.ba, self.bg, self.rate, self.cov = (np.repeat(getattr(one, c)[None], n, 0) for c in ("p", "v", "q", "ba", "bg", "rate", "cov"))
        self.height, self.t_us, self.begun = np.full(n, one.height, float), np.zeros(n, np.int64), np.zeros(n, bool)
        # Rings of past states: the oldest one's place, and how many there are.
        self.times, self.states, self.oldest, self.size = np.zeros((n, RING), np.int64), np.zeros((n, RING, 13)), np.zeros(n, int), np.zeros(n, int)

    def anew(self, j: np.ndarray) -> None:
        for c in ("p", "v", "q", "ba", "bg", "rate", "cov", "height"):
            getattr(self, c)[j] = getattr(self.one, c)
        self.begun[j], self.size[j] = False, 0

    def level(self, j: np.ndarray, acc: np.ndarray, yaw: np.ndarray) -> None:
        o = np.zeros(len(j))
        heading = exponential(np.stack([o, o, o + yaw], -1))
        self.q[j] = product(heading, levelled(np.arctan2(-acc[:, 1], -acc[:, 2]), np.arctan2(acc[:, 0], np.hypot(acc[:, 1], acc[:, 2]))))

    def state(self, j: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p[j], self.v[j], self.q[j], self.rate[j]], 1)

    # ---- the ring

    def push(self, j: np.ndarray) -> None:
        t, newest = self.t_us[j], self.times[j, (self.oldest[j] + self.size[j] - 1) % RING]
        self.size[j[t < newest]] = 0  # the clock went back; an empty ring stays empty
        due = (self.size[j] == 0) | (t - newest >= RING_US)
        j, t = j[due], t[due]
        full, at = self.size[j] == RING, (self.oldest[j] + self.size[j]) % RING
        self.times[j, at], self.states[j, at] = t, self.state(j)
        self.oldest[j] = (self.oldest[j] + full) % RING
        self.size[j] += ~full

    def at(self, j: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether there is a state at t, the state, and t less its time (0 if it was interpolated)."""
        k, each = np.arange(RING), np.arange(len(j))
        places = (self.oldest[j][:, None] + k) % RING
        after = ((k < self.size[j][:, None]) & (self.times[j[:, None], places] <= t[:, None])).sum(1)
        hi_at, lo_at = places[each, np.minimum(after, RING - 1)], places[each, np.maximum(after - 1, 0)]
        entry, some = after < self.size[j], after > 0
        hi_t, hi = np.where(entry, self.times[j, hi_at], self.t_us[j]), np.where(entry[:, None], self.states[j, hi_at], self.state(j))
        lo_t, lo = self.times[j, lo_at], self.states[j, lo_at]
        span = hi_t - lo_t
        between = some & (span <= SPAN_US)
        lower = some & ~between & (t - lo_t < hi_t - t)
        w = np.where(span > 0, (t - lo_t) / np.where(span > 0, span, 1), 0.0)
        other = hi.copy()
        other[:, 6:10] *= np.where((lo[:, 6:10] * hi[:, 6:10]).sum(1) >= 0, 1.0, -1.0)[:, None]  # the shorter arc
        x = np.where(between[:, None], lo + w[:, None] * (other - lo), np.where(lower[:, None], lo, hi))
        x[:, 6:10] = unit(x[:, 6:10])
        rest = np.where(between, 0, t - np.where(lower, lo_t, hi_t))
        return np.abs(rest) <= NEAR_US, x, rest / 1e6

    def past(self, j: np.ndarray, age_s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of j have a state to compare with, these states, and what is missing of their time."""
        found, x, rest = ~(age_s > OLDEST_S), self.state(j), np.zeros(len(j))
        late = found & (age_s > 0)
        if late.any():
            own = j[late]
            found[late], x[late], rest[late] = self.at(own, self.t_us[own] - np.round(age_s[late] * 1e6).astype(np.int64))
        return found, x, rest

    def corrected(self, j: np.ndarray, dx: np.ndarray) -> None:
        j, dx = j[self.size[j] > 0], dx[self.size[j] > 0]
        if not len(j):
            return
        age = ((self.t_us[j][:, None] - self.times[j]) / 1e6)[:, :, None]
        x = self.states[j]
        x[:, :, :3] -= dx[:, None, P] - dx[:, None, V] * age
        x[:, :, 3:6] -= dx[:, None, V]
        x[:, :, 6:10] = product(np.broadcast_to(exponential(-dx[:, T])[:, None], x[:, :, 6:10].shape), x[:, :, 6:10])
        x[:, :, 10:] += dx[:, None, BG]
        self.states[j] = x

    # ---- the filter

    def predict(self, j: np.ndarray, t_us: np.ndarray, gyr: np.ndarray, acc: np.ndarray) -> None:
        one, begun = self.one, self.begun[j]
        dt = np.where(begun, (t_us - self.t_us[j]) / 1e6, 0.0)
        self.push(j[begun])
        self.t_us[j], self.begun[j], self.rate[j] = t_us, True, gyr - self.bg[j]
        go = (dt > 0) & (dt <= one.longest_step)
        j, dt, acc = j[go], dt[go][:, None], acc[go]
        if not len(j):
            return
        p, v, height = self.p[j], self.v[j], self.height[j]
        s = 1 - E2 * np.sin(one.lat) ** 2
        rn, rm = A / np.sqrt(s) + height, A * (1 - E2) / s**1.5 + height
        earth = OMEGA_E * np.array([np.cos(one.lat), 0, -np.sin(one.lat)])
        moving = np.stack([v[:, 1] / rn, -v[:, 0] / rm, -v[:, 1] * np.tan(one.lat) / rn], 1)
        r, f = matrix(self.q[j]), acc - self.ba[j]
        turn = (self.rate[j] - turned(r.transpose(0, 2, 1), earth + moving)) * dt
        push = turned(r, f * dt + 0.5 * np.cross(turn, f) * dt)
        new = v + push - np.cross(2 * earth + moving, v) * dt
        new[:, 2] += gravity(one.lat, height - p[:, 2]) * dt[:, 0]
        self.p[j], self.v[j] = p + 0.5 * (v + new) * dt, new
        self.q[j] = unit(product(self.q[j], exponential(turn)))
        phi = np.repeat(np.eye(15)[None], len(j), 0)
        by_r = -r * dt[:, :, None]
        phi[:, P, V], phi[:, V, T], phi[:, V, BA], phi[:, T, BG] = np.eye(3) * dt[:, :, None], -skew(turned(r, f)) * dt[:, :, None], by_r, by_r
        cov = phi @ self.cov[j] @ phi.transpose(0, 2, 1)
        k = np.arange(15)
        cov[:, k, k] += np.repeat([0.0, one.acc_psd, one.gyr_psd, one.acc_walk, one.gyr_walk], 3) * dt
        self.cov[j] = cov

    def fuse(self, j: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray | float]]) -> None:
        if not len(j):
            return
        cov, dx, threshold = self.cov[j], np.zeros((len(j), 15)), self.one.threshold
        for z, h, var in rows:
            b = turned(cov, h)
            d, s, var = z - (h * dx).sum(1), (h * b).sum(1), np.broadcast_to(var, len(j))
            if threshold > 0:
                var = np.where(d * d > threshold * (s + var), d * d / threshold - s, var)
            k = b / (s + var)[:, None]
            dx += k * d[:, None]
            cov = gained(cov, h, k, var)
        self.cov[j] = cov
        self.p[j], self.v[j], self.ba[j], self.bg[j] = self.p[j] - dx[:, P], self.v[j] - dx[:, V], self.ba[j] - dx[:, BA], self.bg[j] - dx[:, BG]
        self.q[j] = unit(product(exponential(-dx[:, T]), self.q[j]))
        self.corrected(j, dx)

    def position(self, j: np.ndarray, measured: np.ndarray, var: np.ndarray, arm: np.ndarray, age_s: np.ndarray) -> None:
        """var: of each axis, or their covariances."""
        found, x, rest = self.past(j, age_s)
        j, x, rest, measured, var, age_s = j[found], x[found], rest[found], measured[found], var[found], age_s[found]
        l = turned(matrix(x[:, 6:10]), np.broadcast_to(arm, (len(j), 3)))
        z, turn, axis, older = x[:, :3] + x[:, 3:6] * rest[:, None] + l - measured, -skew(l), np.eye(3), np.maximum(age_s, 0.0)[:, None]
        hs = np.stack([row(len(j), p=axis[i], v=-older * axis[i], t=turn[:, i]) for i in range(3)], 1)
        if var.ndim == 3:  # correlated: divided by the covariance's root
            root = np.linalg.inv(np.linalg.cholesky(var))
            z, hs, var = turned(root, z), root @ hs, np.ones((len(j), 3))
        self.fuse(j, [(z[:, i], hs[:, i], var[:, i]) for i in range(3)])

    def velocity(self, j: np.ndarray, measured: np.ndarray, var: np.ndarray, arm: np.ndarray, age_s: np.ndarray) -> None:
        found, x, _ = self.past(j, age_s)
        j, x, measured, var = j[found], x[found], measured[found], var[found]
        l = turned(matrix(x[:, 6:10]), np.cross(x[:, 10:], arm))
        z, turn = x[:, 3:6] + l - measured, -skew(l)
        self.fuse(j, [(z[:, i], row(len(j), v=np.eye(3)[i], t=turn[:, i]), var[:, i]) for i in range(3)])

    def standstill(self, j: np.ndarray, sigma: float) -> None:
        self.fuse(j, [(self.v[j, i], row(len(j), v=np.eye(3)[i]), sigma**2) for i in range(3)])

    def yaw(self, j: np.ndarray, measured: np.ndarray, var: np.ndarray, age_s: np.ndarray) -> None:
        found, x, _ = self.past(j, age_s)
        r = matrix(x[:, 6:10])
        found &= np.abs(r[:, 2, 0]) <= 0.99
        off = np.arctan2(r[:, 1, 0], r[:, 0, 0]) - measured
        self.fuse(j[found], [((off[found] + np.pi) % (2 * np.pi) - np.pi, row(int(found.sum()), t=np.array([0, 0, 1.0])), var[found])])

    def baro(self, j: np.ndarray, height: np.ndarray, var: np.ndarray | float) -> None:
        self.fuse(j, [(-self.p[j, 2] - height, row(len(j), p=np.array([0, 0, -1.0])), var)])

    def speed(self, j: np.ndarray, measured: np.ndarray, var: np.ndarray, age_s: np.ndarray, least: float = 0.5) -> None:
        found, x, _ = self.past(j, age_s)
        n = np.sqrt((x[:, 3:6] ** 2).sum(1))
        found &= n >= least
        n, x = n[found], x[found]
        self.fuse(j[found], [(n - measured[found], row(len(n), v=x[:, 3:6] / n[:, None]), var[found])])

    def sideways(self, j: np.ndarray, sigma: float = 0.1) -> None:
        across = matrix(self.q[j])[:, :, 1]
        self.fuse(j, [((across * self.v[j]).sum(1), row(len(j), v=across, t=np.cross(across, self.v[j])), sigma**2)])

    def anchored(self, j: np.ndarray, p: np.ndarray, v: np.ndarray, p_var: np.ndarray, v_var: np.ndarray, frozen_s: np.ndarray, yaw: np.ndarray, yaw_sigma: np.ndarray) -> None:
        """v NaN: as it was; yaw NaN: unknown."""
        one = self.one
        psd, now = np.repeat([0.0, 0.0, one.gyr_psd, one.acc_walk, one.gyr_walk], 3), np.diagonal(self.cov[j], axis1=1, axis2=2)
        var = inflated(now, psd, frozen_s[:, None], np.maximum(np.diagonal(Inertial().cov), now))
        var[:, P], var[:, V], var[:, 8] = p_var, v_var, yaw_sigma**2
        self.p[j], self.v[j] = p, np.where(there(v)[:, None], v, self.v[j])
        known = ~np.isnan(yaw)
        own = j[known]
        turn = np.zeros((len(own), 3))
        turn[:, 2] = yaw[known] - rpy(self.q[own])[:, 2]
        self.q[own] = product(exponential(turn), self.q[own])
        self.cov[j], self.size[j] = var[:, :, None] * np.eye(15), 0


def columns(frame: pd.DataFrame):
    """Names -> their values as [rows, names], NaN where there is no such column."""
    n, has = len(frame), set(frame.columns)
    return lambda *names: np.stack([frame[c].to_numpy(float) if c in has else np.full(n, np.nan) for c in names], 1)


def filtered(frame: pd.DataFrame, start: np.ndarray, arm: np.ndarray, settings: dict) -> dict[str, np.ndarray]:
    """`inertial.inertial_filter` over a block of recordings: every row's solution by name."""
    t_us, get = frame["t_us"].to_numpy(np.int64), columns(frame)
    imu, fix, fix_var, fix_cov, vel, vel_var = (get(*names) for names in (IMU, FIX, FIX_VAR, FIX_COV, VEL, VEL_VAR))
    yaw, baro, speed = get("yaw", "yaw_var", "yaw_age_s"), get("baro_h", "baro_var"), get("speed", "speed_var", "speed_age_s")
    age, yaw_age, speed_age = (np.nan_to_num(x) for x in (get("fix_age_s")[:, 0], yaw[:, 2], speed[:, 2]))
    place, moving, correlated = there(fix) & there(fix_var), there(vel) & there(vel_var), there(fix_cov)
    across, still = (get(c)[:, 0] == 1 for c in ("sideways", "still"))
    heading, pressed, paced = there(yaw[:, :2]), there(baro), there(speed[:, :2])
    k, out = Fleet(len(start), **settings), np.empty((len(frame), 12))
    for step, (j, i) in enumerate(steps(start, len(frame))):
        if step == 0:
            k.level(j, imu[i, 3:], np.nan_to_num(yaw[i, 0]))
            k.p[j] = np.where(there(fix[i])[:, None], fix[i], k.p[j])
        k.predict(j, t_us[i], imu[i, :3], imu[i, 3:])
        for own, full in ((place[i] & ~correlated[i], False), (place[i] & correlated[i], True)):
            if own.any():
                r = i[own]
                k.position(j[own], fix[r], covariances(fix_var[r], fix_cov[r]) if full else fix_var[r], arm, age[r])
        if (own := moving[i]).any():
            k.velocity(j[own], vel[i[own]], vel_var[i[own]], arm, age[i[own]])
        if (own := heading[i]).any():
            k.yaw(j[own], yaw[i[own], 0], yaw[i[own], 1], yaw_age[i[own]])
        if (own := pressed[i]).any():
            k.baro(j[own], baro[i[own], 0], baro[i[own], 1])
        if (own := paced[i]).any():
            k.speed(j[own], speed[i[own], 0], speed[i[own], 1], speed_age[i[own]])
        k.sideways(j[across[i]])
        k.standstill(j[still[i]], 0.05)
        out[i] = np.concatenate([k.p[j], k.v[j], rpy(k.q[j]), np.sqrt(np.diagonal(k.cov[j], axis1=1, axis2=2)[:, :3])], 1)
    return dict(zip(("n", "e", "d", "vn", "ve", "vd", "roll", "pitch", "yaw", "sd_n", "sd_e", "sd_d"), out.T, strict=True))


def covariances(var: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Matrices from variances and the north-east, north-down and east-down parts."""
    out = var[:, :, None] * np.eye(3)
    for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        out[:, a, b] = out[:, b, a] = off[:, k]
    return out
