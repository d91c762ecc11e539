"""Strapdown inertial navigation with an error state of 15, a recording at a time.

State: position in a local north-east-down frame, velocity, attitude, biases of
the accelerometers and gyros. Errors are nominal minus true; the attitude's error
psi turns the local frame, R_nominal = (I + [psi]) R_true. Measurements come as
scalar rows, one after another; a squared innovation over `threshold` times its
variance is weighted down, or for ranges left out.

A measurement with an age is compared with the state at its time of validity,
which comes from a ring of past states, and corrects the state of now; what is
corrected now is corrected in the ring, too, so that the next late measurement
does not meet an error that is already gone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from driftline.functions.geo import A, E2, FLATTENING, G1, G2, G3, GAMMA_E, M, OMEGA_E
from driftline.operators.filters import Attitude, smoothed
from driftline.operators.lockstep import in_blocks
from driftline.operators.modes import inflated
from driftline.shipping import shipped

P, V, T, BA, BG = (slice(k, k + 3) for k in (0, 3, 6, 9, 12))
product, exponential = Attitude.product, Attitude.exponential


def skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def gravity(lat: float, h: float) -> float:
    s = np.sin(lat) ** 2
    return GAMMA_E * (1 + G1 * s + G2 * s * s + G3 * s**3) * (1 - 2 / A * (1 + FLATTENING + M - 2 * FLATTENING * s) * h + 3 * h * h / A**2)


#: Spacing and size of the ring of past states; the longest span that is interpolated; how far a state may
#: be from the time of validity; the greatest age of a measurement.
RING_US, RING, SPAN_US, NEAR_US, OLDEST_S = 20_000, 30, 100_000, 50_000, 0.5


@dataclass
class Past:
    """A state at a time of validity; rest_s: validity minus the time of this state, 0 if it was interpolated."""

    p: np.ndarray
    v: np.ndarray
    q: np.ndarray
    rate: np.ndarray
    rest_s: float = 0.0

    def matrix(self) -> np.ndarray:
        w, x, y, z = self.q
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


@dataclass
class History:
    """Times and states [time, 13]: position, velocity, quaternion and rate, the oldest first."""

    times: list[int] = field(default_factory=list)
    states: np.ndarray = field(default_factory=lambda: np.zeros((0, 13)))

    def push(self, t_us: int, state: np.ndarray) -> None:
        if self.times and t_us < self.times[-1]:  # the clock went back
            self.times, self.states = [], np.zeros((0, 13))
        if not self.times or t_us - self.times[-1] >= RING_US:
            self.times, self.states = [*self.times[1 - RING :], t_us], np.concatenate([self.states[1 - RING :], state[None]])

    def at(self, t_us: int, now_us: int, now: np.ndarray) -> Past | None:
        """The state at t_us, between the entries around it or the newest entry and the state of now."""
        after = int(np.searchsorted(self.times, t_us, "right"))
        hi_t, hi = (self.times[after], self.states[after]) if after < len(self.times) else (now_us, now)
        rest = 0
        if after:
            lo_t, lo = self.times[after - 1], self.states[after - 1]
            if hi_t - lo_t <= SPAN_US:
                w = (t_us - lo_t) / (hi_t - lo_t) if hi_t > lo_t else 0.0
                other = hi.copy()
                other[6:10] *= 1 if lo[6:10] @ hi[6:10] >= 0 else -1  # the shorter arc
                hi = lo + w * (other - lo)
            else:
                hi_t, hi = (lo_t, lo) if t_us - lo_t < hi_t - t_us else (hi_t, hi)
                rest = t_us - hi_t
        else:
            rest = t_us - hi_t
        if abs(rest) > NEAR_US:
            return None
        return Past(hi[:3], hi[3:6], hi[6:10] / np.linalg.norm(hi[6:10]), hi[10:], rest / 1e6)

    def correct(self, dx: np.ndarray, now_us: int) -> None:
        """Takes the error of now, carried back over each entry's age, out of all entries."""
        if not self.times:
            return
        age = (now_us - np.array(self.times, float))[:, None] / 1e6
        x = self.states.copy()
        x[:, :3] -= dx[P] - dx[V] * age
        x[:, 3:6] -= dx[V]
        w, v = (turn := exponential(-dx[T]))[0], turn[1:]
        q0, q = self.states[:, 6:7], self.states[:, 7:10]
        x[:, 6:7], x[:, 7:10] = w * q0 - q @ v[:, None], w * q + q0 * v + np.cross(v, q)
        x[:, 10:] += dx[BG]
        self.states = x


@dataclass
class Inertial:
    lat: float = 0.8
    height: float = 0.0
    acc_psd: float = 1e-4
    gyr_psd: float = 1e-7
    acc_walk: float = 1e-8
    gyr_walk: float = 1e-12
    threshold: float = 10.0
    longest_step: float = 1.0
    p: np.ndarray = field(default_factory=lambda: np.zeros(3))
    v: np.ndarray = field(default_factory=lambda: np.zeros(3))
    q: np.ndarray = field(default_factory=lambda: np.array([1.0, 0, 0, 0]))
    ba: np.ndarray = field(default_factory=lambda: np.zeros(3))
    bg: np.ndarray = field(default_factory=lambda: np.zeros(3))
    cov: np.ndarray = field(default_factory=lambda: np.diag([25.0] * 3 + [1.0] * 3 + [0.01, 0.01, 1.0] + [0.01] * 3 + [1e-5] * 3))
    t_us: int | None = None
    rate: np.ndarray = field(default_factory=lambda: np.zeros(3))
    phi: np.ndarray = field(default_factory=lambda: np.eye(15))
    rejected: int = 0
    late: int = 0
    history: History = field(default_factory=History)

    def matrix(self) -> np.ndarray:
        w, x, y, z = self.q
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])

    def rpy(self) -> np.ndarray:
        r = self.matrix()
        return np.array([np.arctan2(r[2, 1], r[2, 2]), np.arcsin(np.clip(-r[2, 0], -1, 1)), np.arctan2(r[1, 0], r[0, 0])])

    def level(self, acc: np.ndarray, yaw: float) -> None:
        roll, pitch = np.arctan2(-acc[1], -acc[2]), np.arctan2(acc[0], np.hypot(acc[1], acc[2]))
        self.q = product(product(exponential(np.array([0, 0, yaw])), exponential(np.array([0, pitch, 0]))), exponential(np.array([roll, 0, 0])))

    def begin(self, m: Measured) -> None:
        """Level and position of a first row."""
        self.level(m.imu[3:], 0.0 if np.isnan(m.yaw[0]) else m.yaw[0])
        self.p = m.fix if not np.isnan(m.fix).any() else self.p

    def predict(self, t_us: int, gyr: np.ndarray, acc: np.ndarray) -> None:
        """One sample; the first, and one over longest_step late, moves nothing."""
        dt = 0.0 if self.t_us is None else (t_us - self.t_us) / 1e6
        if self.t_us is not None:
            self.history.push(self.t_us, self.state())
        self.t_us, self.phi = t_us, np.eye(15)
        self.rate = gyr - self.bg
        if not 0 < dt <= self.longest_step:
            return
        s = 1 - E2 * np.sin(self.lat) ** 2
        rn, rm = A / np.sqrt(s) + self.height, A * (1 - E2) / s**1.5 + self.height
        earth = OMEGA_E * np.array([np.cos(self.lat), 0, -np.sin(self.lat)])
        moving = np.array([self.v[1] / rn, -self.v[0] / rm, -self.v[1] * np.tan(self.lat) / rn])
        r, f = self.matrix(), acc - self.ba
        turn = (self.rate - r.T @ (earth + moving)) * dt
        g = np.array([0, 0, gravity(self.lat, self.height - self.p[2])])
        push = r @ (f * dt + 0.5 * np.cross(turn, f) * dt)
        new = self.v + push + (g - np.cross(2 * earth + moving, self.v)) * dt
        self.p, self.v = self.p + 0.5 * (self.v + new) * dt, new
        self.q = product(self.q, exponential(turn))
        self.q /= np.linalg.norm(self.q)
        self.phi[P, V], self.phi[V, T], self.phi[V, BA], self.phi[T, BG] = np.eye(3) * dt, -skew(r @ f) * dt, -r * dt, -r * dt
        noise = np.repeat([0.0, self.acc_psd, self.gyr_psd, self.acc_walk, self.gyr_walk], 3) * dt
        self.cov = self.phi @ self.cov @ self.phi.T + np.diag(noise)

    def state(self) -> np.ndarray:
        return np.concatenate([self.p, self.v, self.q, self.rate])

    def past(self, age_s: float) -> Past | None:
        """The state that a measurement of this age is compared with; None if there is none, or it is too old."""
        if age_s <= 0:
            return Past(self.p, self.v, self.q, self.rate)
        found = self.history.at(self.t_us - round(age_s * 1e6), self.t_us, self.state()) if age_s <= OLDEST_S else None
        self.late += found is None
        return found

    @staticmethod
    def apart(rows: list[tuple[float, np.ndarray, float]], cov: np.ndarray) -> list[tuple[float, np.ndarray, float]]:
        """Rows with correlated errors (cov in place of their variances) as rows without: all divided by cov's root."""
        root = np.linalg.inv(np.linalg.cholesky(cov))
        z, h = root @ np.array([r[0] for r in rows]), root @ np.array([r[1] for r in rows])
        return [(float(a), b, 1.0) for a, b in zip(z, h, strict=True)]

    def fuse(self, rows: list[tuple[float, np.ndarray, float]], skip: bool = False) -> None:
        """rows: predicted minus measured, its derivative by the error state, variance."""
        dx = np.zeros(15)
        for z, h, var in rows:
            d, s = z - h @ dx, h @ self.cov @ h
            if self.threshold > 0 and d * d > self.threshold * (s + var):
                self.rejected += 1
                if skip:
                    continue
                var = d * d / self.threshold - s
            k = self.cov @ h / (s + var)
            dx += k * d
            m = np.eye(15) - np.outer(k, h)
            self.cov = m @ self.cov @ m.T + np.outer(k, k) * var
        self.p, self.v, self.ba, self.bg = self.p - dx[P], self.v - dx[V], self.ba - dx[BA], self.bg - dx[BG]
        self.q = product(exponential(-dx[T]), self.q)
        self.q /= np.linalg.norm(self.q)
        self.history.correct(dx, self.t_us or 0)

    @staticmethod
    def row(**parts: np.ndarray) -> np.ndarray:
        h = np.zeros(15)
        for name, x in parts.items():
            h[{"p": P, "v": V, "t": T, "ba": BA, "bg": BG}[name]] = x
        return h

    def position(self, measured: np.ndarray, var: np.ndarray, arm: np.ndarray = np.zeros(3), age_s: float = 0.0) -> None:
        """var: of each axis, or their covariance."""
        if (past := self.past(age_s)) is None:
            return
        l = past.matrix() @ arm
        z, turn = past.p + past.v * past.rest_s + l - measured, -skew(l)
        rows = [(z[i], self.row(p=np.eye(3)[i], v=-max(age_s, 0.0) * np.eye(3)[i], t=turn[i]), 0.0) for i in range(3)]
        self.fuse([(r[0], r[1], var[i]) for i, r in enumerate(rows)] if np.ndim(var) == 1 else self.apart(rows, var))

    def velocity(self, measured: np.ndarray, var: np.ndarray, arm: np.ndarray = np.zeros(3), age_s: float = 0.0) -> None:
        if (past := self.past(age_s)) is None:
            return
        l = past.matrix() @ np.cross(past.rate, arm)
        z, turn = past.v + l - measured, -skew(l)
        self.fuse([(z[i], self.row(v=np.eye(3)[i], t=turn[i]), var[i]) for i in range(3)])

    def standstill(self, sigma: float, gyro_mean: np.ndarray | None = None, gyro_sigma: float = 1e-3) -> None:
        rows = [(self.v[i], self.row(v=np.eye(3)[i]), sigma**2) for i in range(3)]
        if gyro_mean is not None:
            earth = self.matrix().T @ (OMEGA_E * np.array([np.cos(self.lat), 0, -np.sin(self.lat)]))
            z = self.bg + earth - gyro_mean
            rows += [(z[i], self.row(bg=np.eye(3)[i]), gyro_sigma**2) for i in range(3)]
        self.fuse(rows)

    def yaw(self, measured: float, var: float, age_s: float = 0.0) -> None:
        if (past := self.past(age_s)) is None:
            return
        r = past.matrix()
        yaw, sin_pitch = np.arctan2(r[1, 0], r[0, 0]), -r[2, 0]
        if abs(sin_pitch) <= 0.99:
            self.fuse([((yaw - measured + np.pi) % (2 * np.pi) - np.pi, self.row(t=np.array([0, 0, 1.0])), var)])

    def magnetic(self, measured: np.ndarray, reference: np.ndarray, var: float, tolerance: float = 0.3) -> None:
        """A field vector in the body's axes that turns yaw only: dip and disturbances must not tilt the attitude.

        reference: the field in north-east-down; a strength off by more than its tolerance weakens the measurement.
        """
        r = self.matrix()
        off = abs(float(np.linalg.norm(measured)) / max(float(np.linalg.norm(reference)), 1e-9) - 1)
        z, by_yaw = r.T @ reference - measured, r.T @ np.cross(reference, [0, 0, 1.0])
        self.fuse([(z[i], self.row(t=np.array([0, 0, by_yaw[i]])), var * max(1.0, off / tolerance) ** 2) for i in range(3)])

    def course(self, vel: np.ndarray, sigma: float, least: float = 2.0, floor: float = np.radians(5.0)) -> None:
        """Yaw of a vehicle that moves the way it points."""
        n = float(np.hypot(vel[0], vel[1]))
        if n >= least:
            self.yaw(float(np.arctan2(vel[1], vel[0])), max(sigma / n, floor) ** 2)

    def anchored(self, p: np.ndarray, v: np.ndarray | None, p_var: np.ndarray, v_var: np.ndarray, frozen_s: float, yaw: float | None = None, yaw_sigma: float = np.pi) -> None:
        """Position and velocity from a fix after a time without prediction; the rest is kept and aged, yaw is as given or unknown."""
        first = np.diagonal(Inertial().cov)
        psd = np.repeat([0.0, 0.0, self.gyr_psd, self.acc_walk, self.gyr_walk], 3)
        var = inflated(np.diagonal(self.cov), psd, frozen_s, np.maximum(first, np.diagonal(self.cov)))
        var[P], var[V] = p_var, v_var
        self.p, self.v = p.copy(), self.v if v is None else v.copy()
        if yaw is not None:
            self.q = product(exponential(np.array([0, 0, yaw - self.rpy()[2]])), self.q)
        var[8] = yaw_sigma**2
        self.cov, self.history = np.diag(var), History()

    def baro(self, height: float, var: float) -> None:
        self.fuse([(-self.p[2] - height, self.row(p=np.array([0, 0, -1.0])), var)])

    def speed(self, measured: float, var: float, least: float = 0.5, age_s: float = 0.0, scale: float = 1.0, relative: float = 0.0) -> None:
        """Speed along the path; its sigma has a part of its own (var) and one in proportion to the speed."""
        if (past := self.past(age_s)) is None:
            return
        n = float(np.linalg.norm(past.v))
        if n >= least:
            self.fuse([(n - scale * measured, self.row(v=past.v / n), var + (relative * scale * measured) ** 2)])

    def distance(self, anchor: np.ndarray, measured: float, var: float, arm: np.ndarray = np.zeros(3), age_s: float = 0.0, height_known: bool = False) -> None:
        """Distance to a point; where the height comes from elsewhere, the vertical part of its error is noise."""
        if (past := self.past(age_s)) is None:
            return
        l = past.matrix() @ arm
        d = past.p + past.v * past.rest_s + l - anchor
        n = float(np.linalg.norm(d))
        if n < 1.0:
            return
        u, turn = d / n, -(d / n) @ skew(l)
        if height_known:
            var, u = var + u[2] ** 2 * self.cov[2, 2], u * np.array([1.0, 1, 0])
        self.fuse([(n - measured, self.row(p=u, v=-max(age_s, 0.0) * u, t=turn), var)], skip=True)

    def sideways(self, sigma: float = 0.1) -> None:
        """No motion across the body's length."""
        r = self.matrix()
        across = r[:, 1]
        self.fuse([(across @ self.v, self.row(v=across, t=np.cross(across, self.v)), sigma**2)])


#: Columns of aligned rows: an imu sample and, where there is one, the newest of each other stream.
IMU = ["gyr_x", "gyr_y", "gyr_z", "acc_x", "acc_y", "acc_z"]
FIX, FIX_VAR, VEL, VEL_VAR = ([f"{n}_{a}" for a in "ned"] for n in ("fix", "fix_var", "vel", "vel_var"))
#: Off-diagonal covariances of a fix: north-east, north-down, east-down.
FIX_COV = ["fix_cov_ne", "fix_cov_nd", "fix_cov_ed"]
OUT = "recording_id {id}, t_us long, seq long, " + ", ".join(f"{n} double" for n in ("n", "e", "d", "vn", "ve", "vd", "roll", "pitch", "yaw", "sd_n", "sd_e", "sd_d"))


@dataclass
class Measured:
    """What a row offers; NaN where nothing."""

    imu: np.ndarray
    fix: np.ndarray
    fix_var: np.ndarray
    fix_cov: np.ndarray
    vel: np.ndarray
    vel_var: np.ndarray
    fix_age: float
    yaw: np.ndarray
    baro: np.ndarray
    speed: np.ndarray
    ranges: list
    sideways: bool
    still: bool


def measured_rows(frame: pd.DataFrame):
    """Row number -> Measured."""
    has = set(frame.columns)
    col = {c: frame[c].to_numpy(float) for c in has - {"recording_id", "t_us", "seq", "ranges"} if pd.api.types.is_numeric_dtype(frame[c]) or frame[c].dtype == object}
    ranges = frame["ranges"].tolist() if "ranges" in has else None
    get = lambda i, *names: np.array([col[c][i] if c in col else np.nan for c in names])
    age = lambda i, name: float(np.nan_to_num(get(i, name)[0]))
    return lambda i: Measured(
        get(i, *IMU), get(i, *FIX), get(i, *FIX_VAR), get(i, *FIX_COV), get(i, *VEL), get(i, *VEL_VAR), age(i, "fix_age_s"), np.append(get(i, "yaw", "yaw_var"), age(i, "yaw_age_s")), get(i, "baro_h", "baro_var"),
        np.append(get(i, "speed", "speed_var"), age(i, "speed_age_s")), [] if ranges is None or ranges[i] is None else list(ranges[i]), get(i, "sideways")[0] == 1, get(i, "still")[0] == 1,
    )


def correct(k: Inertial, m: Measured, arm: np.ndarray, to_ranges: np.ndarray) -> None:
    """All measurements of a row, in fixed order."""
    there = lambda *xs: not any(np.isnan(x).any() for x in xs)
    if there(m.fix, m.fix_var):
        ne, nd, ed = m.fix_cov
        k.position(m.fix, np.diag(m.fix_var) + np.array([[0, ne, nd], [ne, 0, ed], [nd, ed, 0]]) if there(m.fix_cov) else m.fix_var, arm, m.fix_age)
    if there(m.vel, m.vel_var):
        k.velocity(m.vel, m.vel_var, arm, m.fix_age)
    if there(m.yaw):
        k.yaw(*m.yaw)
    if there(m.baro):
        k.baro(*m.baro)
    if there(m.speed):
        k.speed(m.speed[0], m.speed[1], age_s=m.speed[2])
    for n, e, d, distance, var, age in m.ranges:
        k.distance(np.array([n, e, d]), distance, var, to_ranges, age, there(m.baro))
    if m.sideways:
        k.sideways()
    if m.still:
        k.standstill(0.05)


def inertial_filter(df: DataFrame, smooth: bool = False, fix_arm: tuple = (0.0, 0.0, 0.0), range_arm: tuple = (0.0, 0.0, 0.0), **settings) -> DataFrame:
    """Position, velocity, attitude and position sigmas for each row of aligned streams; with smooth, from both directions.

    Besides recording_id, t_us and seq the rows have the columns IMU, and may have FIX, FIX_VAR, FIX_COV, VEL, VEL_VAR and
    fix_age_s (of both), yaw, yaw_var and yaw_age_s, baro_h and baro_var, speed, speed_var and speed_age_s, ranges (arrays
    of anchor n, e, d, distance, variance and age), sideways and still (1: the constraint holds); null where there is no
    measurement, ages 0 where null. fix_arm and range_arm: from the sensor to the antenna, in the body's axes.
    """
    arm, to_ranges = np.array(fix_arm, float), np.array(range_arm, float)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t_us", "seq"])
        k, out = Inertial(**settings), []
        phi, before, after, states, turns = [], [], [], [], []
        rows = measured_rows(frame)
        for i, t in enumerate(frame["t_us"]):
            m = rows(i)
            if i == 0:
                k.begin(m)
            k.predict(int(t), m.imu[:3], m.imu[3:])
            phi.append(k.phi)
            before.append(k.cov)
            moved = np.concatenate([k.p, k.v, np.zeros(3), k.ba, k.bg])
            q = k.q
            correct(k, m, arm, to_ranges)
            after.append(k.cov)
            # The correction as an error state: what the smoother carries back.
            turn = product(k.q, np.concatenate([q[:1], -q[1:]]))
            states.append(np.concatenate([k.p, k.v, np.zeros(3), k.ba, k.bg]) - moved + np.concatenate([np.zeros(6), 2 * turn[1:] * np.sign(turn[0] or 1), np.zeros(6)]))
            turns.append(k.q)
            out.append(np.concatenate([k.p, k.v, k.rpy(), np.sqrt(np.diag(k.cov)[:3])]))
        x = np.array(out)
        if smooth and len(x) > 1:
            zero = np.zeros((len(x), 15))
            dx, ps = smoothed(np.array(phi[1:]), np.array(before), np.array(after), zero, np.array(states))
            extra = dx - np.array(states)
            x[:, :6] += extra[:, :6]
            for i, q in enumerate(turns):  # the error turns the local frame
                k.q = product(Attitude.exponential(extra[i, 6:9]), q)
                x[i, 6:9] = k.rpy()
            x[:, 9:] = np.sqrt(np.maximum(np.diagonal(ps, axis1=1, axis2=2)[:, :3], 0))
        names = [c.split()[0] for c in OUT.format(id="x").split(", ")][3:]
        return pd.concat([frame[["recording_id", "t_us", "seq"]].reset_index(drop=True), pd.DataFrame(x, columns=names)], axis=1)

    if not smooth and "ranges" not in df.columns:  # the recordings of a block step together
        from driftline.operators.fleet import filtered

        return in_blocks(df, lambda frame, start: filtered(frame, start, arm, settings), ", ".join(OUT.split(", ")[3:]))
    shipped(df.sparkSession)
    return df.groupBy("recording_id").applyInPandas(run, OUT.format(id=df.schema["recording_id"].dataType.simpleString()))
