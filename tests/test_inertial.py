import numpy as np
import pandas as pd
import pytest

from driftline.operators import inertial


def drive(seconds=60, rate=50, seed=1, gyro_bias=(0.002, -0.001, 0.003)):
    """A level circle: radius 50 m, 5 m/s, with exact specific force in a frame without earth rate."""
    rng = np.random.default_rng(seed)
    t = np.arange(seconds * rate) / rate
    w = 0.1
    yaw = w * t
    pos = 50 * np.stack([np.sin(yaw), 1 - np.cos(yaw), 0 * t], 1)
    vel = 5 * np.stack([np.cos(yaw), np.sin(yaw), 0 * t], 1)
    acc = np.tile([0, 5 * w, -inertial.gravity(0.8, 0.0)], (len(t), 1)) + rng.normal(0, 0.02, (len(t), 3))
    gyr = np.tile([0, 0, w], (len(t), 1)) + gyro_bias + rng.normal(0, 0.001, (len(t), 3))
    df = pd.DataFrame(np.concatenate([gyr, acc], 1), columns=inertial.IMU)
    df.insert(0, "seq", range(len(t)))
    df.insert(0, "t_us", (t * 1e6).round().astype(int))
    df.insert(0, "recording_id", "r")
    fix = pos + rng.normal(0, 0.5, pos.shape)
    on = np.arange(len(t)) % rate == 0
    for k, (f, v) in enumerate(zip(inertial.FIX, inertial.FIX_VAR)):
        df[f], df[v] = np.where(on, fix[:, k], np.nan), np.where(on, 0.25, np.nan)
    for k, (f, v) in enumerate(zip(inertial.VEL, inertial.VEL_VAR)):
        df[f], df[v] = np.where(on, vel[:, k] + rng.normal(0, 0.05, len(t)), np.nan), np.where(on, 0.0025, np.nan)
    df["yaw"], df["yaw_var"] = np.where(df.seq == 0, 0.05, np.nan), np.where(df.seq == 0, 0.01, np.nan)
    return df, pos, vel, yaw


def test_filter_and_smoother_follow_a_circle(spark):
    df, pos, vel, yaw = drive()
    frame = spark.createDataFrame(df.astype(object).where(df.notna(), None), "recording_id string, t_us long, seq long, " + ", ".join(f"{c} double" for c in df.columns[3:]))
    one = inertial.inertial_filter(frame).orderBy("seq").toPandas()
    two = inertial.inertial_filter(frame, smooth=True).orderBy("seq").toPandas()
    late = slice(1000, None)
    rms = lambda o: np.sqrt(((o[["n", "e", "d"]].to_numpy() - pos)[late] ** 2).sum(1).mean())
    assert rms(one) < 0.6 and rms(two) < rms(one)
    off = (one.yaw.to_numpy() - yaw + np.pi) % (2 * np.pi) - np.pi
    assert np.abs(off[late]).max() < 0.25  # next to free accelerometer biases, yaw shows slowly
    assert np.abs((one[["vn", "ve", "vd"]].to_numpy() - vel)[late]).max() < 0.3


def test_rows_are_the_derivatives_of_the_measurements():
    rng = np.random.default_rng(2)
    k = inertial.Inertial()
    k.q = rng.normal(size=4)
    k.q /= np.linalg.norm(k.q)
    k.p, k.v, k.rate = rng.normal(size=3) * 10, rng.normal(size=3) * 3, rng.normal(size=3)
    arm, anchor, seen = np.array([1.0, -2, 0.5]), np.array([30.0, -20, 5]), []
    k.fuse = lambda rows, skip=False: seen.append(rows)
    p, v, q = k.p.copy(), k.v.copy(), k.q.copy()

    def at(dx):
        k.p, k.v, k.q = p + dx[inertial.P], v + dx[inertial.V], inertial.product(inertial.exponential(dx[inertial.T]), q)
        seen.clear()
        k.position(np.zeros(3), np.ones(3), arm)
        k.velocity(np.zeros(3), np.ones(3), arm)
        k.distance(anchor, 0.0, 1.0, arm)
        k.speed(0.0, 1.0)
        k.sideways()
        return [r for rows in seen for r in rows]

    base = at(np.zeros(15))
    for c in range(9):
        up, down = at(1e-6 * np.eye(15)[c]), at(-1e-6 * np.eye(15)[c])
        for (z, h, _), (a, *_), (b, *_) in zip(base, up, down):
            assert h[c] == pytest.approx((a - b) / 2e-6, abs=1e-5)


def test_standstill_finds_gyro_bias():
    k = inertial.Inertial()
    g = np.array([0, 0, -inertial.gravity(0.8, 0.0)])
    bias = np.array([0.001, -0.002, 0.0005])
    k.level(g, 0.0)
    for i in range(2000):
        k.predict(i * 10_000, bias, g)
        if i % 20 == 0:
            k.standstill(0.01, bias, 1e-4)
    assert k.bg == pytest.approx(bias, abs=1e-4)
    assert np.abs(k.v).max() < 0.05


def late(df, frames, by_s):
    """The same drive with its fixes and velocities by_s late, and their age."""
    steps = round(by_s * 50)
    out = df.copy()
    names = [*inertial.FIX, *inertial.FIX_VAR, *inertial.VEL, *inertial.VEL_VAR]
    out[names] = df[names].shift(steps)
    out["fix_age_s"] = np.where(out[inertial.FIX[0]].notna(), by_s, np.nan)
    return out


def as_frame(spark, df):
    return spark.createDataFrame(df.astype(object).where(df.notna(), None), "recording_id string, t_us long, seq long, " + ", ".join(f"{c} double" for c in df.columns[3:]))


@pytest.mark.parametrize("every", [50, 4])  # the next fix comes after the last one is in, and before
def test_late_fixes_give_the_track_of_fixes_on_time(spark, every):
    df, pos, vel, _ = drive(40)
    names = [*inertial.FIX, *inertial.VEL]
    rng = np.random.default_rng(5)
    noise = np.concatenate([rng.normal(0, 0.5, (len(df), 3)), rng.normal(0, 0.05, (len(df), 3))], 1)
    on = np.arange(len(df)) % every == 0
    df[names] = np.where(on[:, None], np.concatenate([pos, vel], 1) + noise, np.nan)
    df[inertial.FIX_VAR], df[inertial.VEL_VAR] = np.where(on, 0.25, np.nan)[:, None].repeat(3, 1), np.where(on, 0.0025, np.nan)[:, None].repeat(3, 1)
    track = lambda frame: inertial.inertial_filter(as_frame(spark, frame)).orderBy("seq").toPandas()[["n", "e", "d", "vn", "ve", "vd"]].to_numpy()
    shifted = late(df, None, 0.2)
    on_time, in_time, no_age = track(df), track(shifted), track(shifted.drop(columns="fix_age_s"))
    off = np.linalg.norm((in_time - on_time)[500:, :3], axis=1)
    # While a fix is under way, the track on time has a correction that the other one cannot have yet; once it is in, they agree.
    settled = off[np.arange(len(off)) % every >= 10] if every > 10 else off
    print(every, settled.max(), settled.mean(), np.linalg.norm((no_age - on_time)[500:, :3], axis=1).mean())
    assert settled.max() < (0.15 if every > 10 else 0.3) and off.mean() < 0.1
    # Without ages the track is a metre behind (5 m/s).
    assert np.linalg.norm((no_age - on_time)[500:, :3], axis=1).mean() > 0.8


def test_states_of_the_past():
    h = inertial.History()
    for k in range(200):  # 5 ms apart: the ring keeps every fourth
        h.push(k * 5000, np.r_[k * 5000.0, np.zeros(5), 1, np.zeros(6)])
    assert len(h.times) == inertial.RING and np.all(np.diff(h.times) == inertial.RING_US)
    now = np.r_[1e6, np.zeros(5), 1, np.zeros(6)]
    assert h.at(813_000, 1_000_000, now).p[0] == pytest.approx(813_000)
    assert h.at(995_000, 1_000_000, now).p[0] == pytest.approx(995_000)  # between the newest entry and now
    held = h.at(h.times[0] - 30_000, 1_000_000, now)
    assert held.rest_s == pytest.approx(-0.03) and held.p[0] == h.times[0]
    assert h.at(h.times[0] - 60_000, 1_000_000, now) is None
    h.push(10, now)
    assert h.times == [10]  # the clock went back


def test_too_old_measurements_change_nothing():
    k = inertial.Inertial()
    for i in range(100):
        k.predict(i * 10_000, np.zeros(3), np.array([0, 0, -9.8]))
    p = k.p.copy()
    k.position(np.ones(3) * 100, np.ones(3), age_s=0.6)
    assert k.late == 1 and np.array_equal(k.p, p)


def test_correlated_rows_equal_one_vector_update():
    rng = np.random.default_rng(3)
    k = inertial.Inertial(threshold=0)
    a = rng.normal(size=(15, 15))
    k.cov = p = a @ a.T
    r = np.array([[2.0, 0.5, -0.3], [0.5, 1.0, 0.2], [-0.3, 0.2, 3.0]])
    h = np.zeros((3, 15))
    h[:, :3] = np.eye(3)
    measured = rng.normal(size=3)
    z = k.p - measured
    k.position(measured, r)
    gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
    assert k.p == pytest.approx(-(gain @ z)[:3], abs=1e-9)
    assert k.cov == pytest.approx((np.eye(15) - gain @ h) @ p, abs=1e-8)


def test_columns_of_speed_range_and_sideways_reach_the_filter(spark):
    df, pos, vel, _ = drive(30)
    df.loc[df.index > 500, [*inertial.FIX, *inertial.VEL]] = np.nan  # an outage
    on = np.arange(len(df)) % 10 == 5
    df["speed"], df["speed_var"] = np.where(on, 5.0, np.nan), np.where(on, 0.0025, np.nan)
    df["sideways"] = on * 1.0
    anchors = np.array([[200.0, 0, -10], [-100, 200, -20], [0, -150, -5]])
    base = as_frame(spark, df)
    ranges = [(i, [[*a.tolist(), float(np.linalg.norm(pos[i] - a)), 0.04, 0.0] for a in anchors]) for i in np.flatnonzero(on).tolist()]
    both = base.join(spark.createDataFrame(ranges, "seq long, ranges array<array<double>>"), "seq", "left")
    off = lambda f: np.linalg.norm(inertial.inertial_filter(f).orderBy("seq").toPandas()[["n", "e", "d"]].to_numpy() - pos, axis=1)[-1]
    free = off(base.drop("speed", "speed_var", "sideways"))
    assert off(both) < 1.0 < free
    assert off(base) < free  # speed and the constraint alone


def test_late_fix_track_equals_a_loop(spark, sf_dir):
    from driftline.plans import navigation

    got = {(r.recording_id, r.seq): (r.n, r.e, r.d, r.yaw) for r in navigation.late_fix_track(spark, sf_dir).collect()}
    rows = navigation.drives(spark, sf_dir).toPandas().sort_values(["recording_id", "t_us", "seq"])
    assert len(got) == len(rows)
    for _, own in list(rows.groupby("recording_id"))[:5]:
        k = inertial.Inertial()
        for first, r in enumerate(own.to_dict("records")):
            fix = np.array([r[c] for c in inertial.FIX])
            if not first:
                k.level(np.array([r[c] for c in inertial.IMU[3:]]), 0.0)
                k.p = fix if not np.isnan(fix).any() else k.p
            k.predict(r["t_us"], np.array([r[c] for c in inertial.IMU[:3]]), np.array([r[c] for c in inertial.IMU[3:]]))
            if not np.isnan(fix).any():
                k.position(fix, np.full(3, 0.25), age_s=r["fix_age_s"])
            if r["baro_h"] == r["baro_h"]:
                k.baro(r["baro_h"], 1.0)
            if r["speed"] == r["speed"]:
                k.speed(r["speed"], 0.04)
            assert got[r["recording_id"], r["seq"]] == pytest.approx((*k.p, k.rpy()[2]), abs=2e-6)
