"""Modes, stillness, levelling, the suite, pose calibration, thinning of tracks and the magnetic field against loops and known truth."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.functions import magnetics
from driftline.functions.geo import A, E2
from driftline.operators import calibration, inertial, modes, poses, stillness, suite, thinning
from driftline.plans import navigation
from tests.test_inertial import as_frame, drive


# ---- modes


def test_modes_follow_a_hand_written_sequence():
    g = modes.Gate(dwell_s=3, gap_s=2, stop_s=3, stop_step_s=2, coast_s=5, fresh_s=2, imu_s=0.5)
    s = 1_000_000
    good, bad, none = (True, True, True), (True, False, False), (False, False, False)
    told = []
    feed = {0: good, 1: good, 2: bad, 3: good, 4: good, 5: good, 6: good, 7: good, 8: none, 12: none, 14: good, 15: bad, 16: bad, 18: bad, 19: bad, 21: good, 22: good, 23: good, 24: good}
    for half in range(50):  # a sample each 0.5 s, aiding at whole seconds
        t = half * s // 2
        event = g.step(t, *(feed.get(half // 2, none) if half % 2 == 0 else none))
        told.append((t / s, event, g.mode(t)))
    assert [(t, e) for t, e, _ in told if e] == [(6.0, "enter"), (14.0, "reacquire"), (18.0, "quality_loss"), (24.0, "enter")]
    mode = {t: m for t, _, m in told}
    assert [mode[t] for t in (5.5, 6.0, 9.0, 9.5, 12.0, 12.5, 13.5, 14.0, 17.5, 18.0, 24.0)] == [1, 3, 3, 2, 2, 1, 1, 3, 2, 1, 3]
    assert g.step(26 * s, *good) == "imu_loss" and not g.running


def test_an_outage_between_bad_epochs_does_not_fill_the_time():
    g = modes.Gate(dwell_s=0, stop_s=5, stop_step_s=2, least_hz=0, imu_s=1e9)
    assert g.step(0, True, True, True) == "enter"
    g.step(1_000_000, True, False, False)
    assert g.step(61_000_000, True, False, False) is None and g.bad_s == 2.0


def test_frozen_variances_grow_up_to_a_cold_start():
    var = modes.inflated(np.array([1.0, 1.0, 9.0]), np.array([0.1, 1.0, 1.0]), 20.0, np.array([4.0, 4.0, 4.0]))
    assert var.tolist() == [3.0, 4.0, 9.0]  # what was less certain than a cold start stays so
    assert modes.healthy(np.zeros(3), np.eye(3)) and not modes.healthy(np.array([np.nan]), np.eye(1)) and not modes.healthy(np.zeros(2), np.diag([1.0, -1.0]))
    assert modes.overconfident(np.diag([1e-9, 1, 1] + [1.0] * 12)) and not modes.overconfident(np.eye(15))


# ---- stillness and levelling


def test_rest_is_found_where_it_begins_and_ends():
    rng, k, on = np.random.default_rng(0), stillness.Still(), []
    for i in range(2000):  # 100 Hz: rest from 5 to 12 s
        moving = not 500 <= i < 1200
        gyr = rng.normal(0, 0.2 if moving else 5e-4, 3) + 0.01
        acc = np.array([0, 0, -9.81]) + rng.normal(0, 1.0 if moving else 0.02, 3)
        k.step(i * 10_000, gyr, acc)
        on.append(k.active)
    found = np.flatnonzero(on)
    assert 540 <= found[0] <= 570 and 1200 <= found[-1] + 1 <= 1225 and np.all(np.diff(found) == 1)


def test_a_frozen_sensor_and_a_known_speed_are_no_rest():
    frozen, slow = stillness.Still(), stillness.Still()
    rng = np.random.default_rng(1)
    for i in range(300):
        frozen.step(i * 10_000, np.zeros(3), np.array([0, 0, -9.81]))
        slow.step(i * 10_000, rng.normal(0, 5e-4, 3), np.array([0, 0, -9.81]) + rng.normal(0, 0.02, 3), speed=5.0 if i % 100 == 0 else None)
    assert not frozen.active and not slow.active


def test_the_level_is_that_of_the_medians():
    w, rng = stillness.LevelWindow(window_s=0.2), np.random.default_rng(2)
    roll, pitch = 0.2, -0.1
    f = 9.80665 * np.array([np.sin(pitch), -np.sin(roll) * np.cos(pitch), -np.cos(roll) * np.cos(pitch)])
    assert w.solve() is None
    for i in range(30):
        acc = f + rng.normal(0, 0.01, 3) + (50.0 if i % 10 == 9 else 0.0)  # knocks
        w.push(i * 10_000, rng.normal(0, 1e-3, 3), acc)
    own = np.median([s[2] for s in w.samples if s[0] >= 290_000 - 200_000], axis=0)
    r, p, sigma = w.solve()
    assert (r, p) == (math.atan2(-own[1], -own[2]), math.atan2(own[0], math.hypot(own[1], own[2])))
    assert (r, p) == pytest.approx((roll, pitch), abs=0.01) and sigma == 0.0
    w.push(300_000, np.array([1.0, 0, 0]), f)
    assert w.solve()[2] == w.moving_sigma  # it turns
    w.push(0, np.zeros(3), f)
    assert len(w.samples) == 1  # the clock went back


def test_level_track(spark):
    df, *_ = drive(2, rate=25)
    out = stillness.level_track(as_frame(spark, df)).orderBy("seq").toPandas()
    assert out.roll[:2].isna().all() and out.roll[2:].notna().all()


# ---- suite


@pytest.fixture(scope="module")
def outage():
    """A circle with a measured yaw each second, pressure, and no fix from 20 to 40 s."""
    df, pos, vel, yaw = drive(60, rate=25)
    df["pressure"] = 101325 * (1 - 100 / 44330) ** 5.255
    at = df.seq % 25 == 0
    df["yaw"], df["yaw_var"] = np.where(at, yaw, np.nan), np.where(at, 0.01, np.nan)
    df.loc[(df.t_us > 20e6) & (df.t_us < 40e6), inertial.FIX] = np.nan
    return df, pos, yaw


def test_suite_goes_through_its_modes(outage):
    df, pos, yaw = outage
    k = suite.Suite(origin_height=300.0)
    out = pd.DataFrame([k.step(m) for m in suite.epochs(df)])
    t = df.t_us / 1e6
    assert [(round(x, 2), e) for x, e in zip(t, out.event) if e] == [(6.0, "enter"), (40.0, "reacquire")]
    at = lambda x: out[np.isclose(t, x)].iloc[0]
    assert [at(x)["mode"] for x in (0.0, 3.0, 6.0, 21.96, 22.04, 29.96, 30.04, 39.96, 40.0, 59.0)] == [0, 1, 3, 3, 2, 2, 1, 1, 3, 3]
    sources = lambda x: tuple(at(x)[["attitude_source", "height_source", "ellipsoid_source"]])
    assert sources(3.0) == ("ars", "vertical", "offset") and sources(10.0) == ("ins", "ins", "ins")
    assert sources(25.0) == ("ins", "vertical", "offset") and sources(32.0) == ("ars_carried", "vertical", "offset")
    off = lambda x: abs(suite.wrapped(at(x)["yaw"] - yaw[np.isclose(t, x)][0]))
    assert off(15.0) < 0.15 and off(32.0) < 0.2 and off(45.0) < 0.2
    far = np.hypot(out.n - pos[:, 0], out.e - pos[:, 1])
    assert far[t > 41].mean() < 1.0 and np.isnan(out.n[t == 35]).all()
    # No step where the source of the height changes, and the ellipsoidal height is that of the origin (300 m).
    assert out.height.diff().abs().max() < 0.6
    assert (out.ellipsoid[t > 10] - 300).abs().max() < 2.0


def test_suite_after_a_loss_of_samples(outage):
    df, *_ = outage
    cut = df[(df.t_us < 10e6) | (df.t_us > 12e6)]
    k = suite.Suite()
    out = pd.DataFrame([k.step(m) for m in suite.epochs(cut)]).assign(t=(cut.t_us / 1e6).to_numpy())
    lost = out[out.event == "imu_loss"].iloc[0]
    assert lost.t > 12 and out[(out.t > 12) & (out.t < 16)]["mode"].max() <= 1
    again = out[(out.event == "enter") & (out.t > 12)].iloc[0]
    assert again.t >= 17 and k.biases is not None and k.zero is not None


def test_magnetometer_gives_the_heading_without_fixes():
    df, pos, vel, yaw = drive(20, rate=25)
    df[inertial.FIX] = np.nan
    field = np.array([20.0, 0, 45.0])  # level: the horizontal part points north
    df[suite.MAG] = [[field[0] * math.cos(y), -field[0] * math.sin(y), field[2]] for y in yaw]
    k = suite.Suite()
    out = [k.step(m) for m in suite.epochs(df)]
    assert out[-1]["attitude_source"] == "ahrs" and abs(suite.wrapped(out[-1]["yaw"] - yaw[-1])) < 0.05


def test_magnetic_rows_turn_yaw_only():
    k = inertial.Inertial()
    k.level(np.array([0.5, 0.3, -9.7]), 0.3)
    roll, pitch, _ = k.rpy()
    true = inertial.Inertial()
    true.level(np.array([0.5, 0.3, -9.7]), 0.5)
    reference = np.array([20.0, 1.0, 45.0])
    for _ in range(20):
        k.magnetic(true.matrix().T @ reference, reference, 1.0)
    assert k.rpy() == pytest.approx([roll, pitch, 0.5], abs=0.02)
    k.course(np.array([0.0, 5.0, 0]), 0.1)
    k.course(np.array([0.0, 1.0, 0]), 0.1)  # too slow to tell
    assert k.rpy()[2] > 0.5


def test_suite_query_equals_the_kernel(spark, sf_dir):
    got = {(r.recording_id, r.seq): (r.mode, r.event, r.attitude_source) for r in navigation.suite_modes(spark, sf_dir).collect()}
    rows = navigation.drives(spark, sf_dir).withColumn("pressure", F.when(F.col("seq") % 3 == 0, 101_325.0 - F.col("acc_x") * 100)).toPandas()
    assert len(got) == len(rows) and {m for m, *_ in got.values()} == {0, 1, 2, 3}
    for _, own in list(rows.groupby("recording_id"))[:3]:
        own = own.sort_values(["t_us", "seq"])
        k = suite.Suite(gate=modes.Gate(dwell_s=0.2, gap_s=0.5, coast_s=0.2, fresh_s=0.05, least_hz=5.0), level=stillness.LevelWindow(window_s=0.06))
        for r, m in zip(own.itertuples(), suite.epochs(own)):
            s = k.step(m)
            assert got[r.recording_id, r.seq] == (s["mode"], s["event"], s["attitude_source"])


# ---- poses


def session(seed, rate=50, poses_n=16):
    """A sensor with errors laid down in random poses with turns between: rows, and the true matrices and biases."""
    rng = np.random.default_rng(seed)
    ma, ba = poses.acc_model(np.array([0.01, -0.008, 0.012, 1.02, 0.985, 1.01, 0.15, -0.2, 0.1]))
    mg, bg = np.eye(3) * [1.01, 0.98, 1.03] + np.array([[0, 0.01, -0.005], [0.004, 0, 0.006], [-0.01, 0.003, 0]]), np.array([0.01, -0.02, 0.005])
    r, rate_rows, force, down = np.eye(3), [], [], np.array([0, 0, 9.80665])
    for k in range(poses_n):
        for _ in range(rate * (8 if k == 0 else 4)):
            rate_rows.append(np.zeros(3))
            force.append(-r.T @ down)
        axis = rng.normal(size=3)
        axis *= rng.uniform(1.0, 2.5) / np.linalg.norm(axis) / 2  # over two seconds
        for _ in range(rate * 2):
            rate_rows.append(axis)
            q = inertial.exponential(axis / rate)
            k_ = inertial.Inertial()
            k_.q = q
            force.append(-r.T @ down)
            r = r @ k_.matrix()
    w, f = np.array(rate_rows), np.array(force)
    still = np.linalg.norm(w, axis=1) == 0
    acc = f @ np.linalg.inv(ma).T + ba + rng.normal(0, 0.01, f.shape) + (~still)[:, None] * rng.normal(0, 0.5, f.shape)
    gyr = w @ np.linalg.inv(mg).T + bg + rng.normal(0, 5e-4, w.shape)
    df = pd.DataFrame(np.concatenate([acc, gyr], 1), columns=[*poses.ACC, *poses.GYR])
    df.insert(0, "seq", range(len(df)))
    df.insert(0, "t_us", df.seq * 1_000_000 // rate)
    df.insert(0, "recording_id", f"s{seed}")
    return df, (ma, ba, mg, bg)


def test_pose_calibration_recovers_matrices_and_biases(spark):
    made = [session(s) for s in (1, 2)]
    few, _ = session(3, poses_n=5)  # too few poses: no row
    df = spark.createDataFrame(pd.concat([d for d, _ in made] + [few]))
    out = {r.recording_id: r for r in poses.pose_calibration(df, window=51, rest_s=6.0, least_rows=80).collect()}
    assert set(out) == {"s1", "s2"}
    for d, (ma, ba, mg, bg) in made:
        r = out[d.recording_id[0]]
        assert r.poses == 16
        assert np.array(r.acc_matrix).reshape(3, 3) == pytest.approx(ma, abs=2e-3) and np.array(r.acc_bias) == pytest.approx(ba, abs=1e-2)
        assert np.array(r.gyr_matrix).reshape(3, 3) == pytest.approx(mg, abs=5e-3) and np.array(r.gyr_bias) == pytest.approx(bg, abs=5e-4)
        assert r.acc_rms < 0.01 < r.acc_raw_rms and r.gyr_rms < 0.01 < r.gyr_raw_rms
    told = {(r.recording_id, r.warning) for r in poses.quality_warnings(spark.createDataFrame(list(out.values()))).collect()}
    assert told == {("s1", "few_poses"), ("s2", "few_poses")}


def test_the_sweep_equals_a_loop(spark):
    df, _ = session(4, poses_n=3)
    x, h = df[list(poses.ACC)].to_numpy(), 25
    v = np.full(len(x), np.nan)
    for i in range(h, len(x) - h):
        v[i] = np.linalg.norm(x[i - h : i + h + 1].var(axis=0, ddof=1))
    quiet = np.nanpercentile(v[df.t_us <= 6e6], 10)
    want = set()
    for m in range(2, 11):
        still, start = np.append(v < m * quiet, False), None
        for i, s in enumerate(still):
            if s and start is None:
                start = i
            if not s and start is not None:
                if i - start >= 80:
                    want.add((m, int(df.t_us[start]), int(df.t_us[i - 1]), i - start))
                start = None
    got = {(r.multiple, r.t0_us, r.t1_us, r.n) for r in poses.pose_sweep(spark.createDataFrame(df), window=51, rest_s=6.0, least_rows=80).collect()}
    assert got == want and len(got) > 9


def test_turns_of_a_batch_equal_steps_one_by_one():
    rng = np.random.default_rng(3)
    gyr, t, spans = rng.normal(0, 1, (400, 3)), np.cumsum(rng.uniform(0.005, 0.015, 400)), [(0, 57), (100, 101), (120, 399)]
    m, b = np.eye(3) + rng.normal(0, 0.02, (3, 3)), rng.normal(0, 0.01, 3)
    q = poses.Turns(gyr, t, spans).quaternions(m, b)
    for k, (lo, hi) in enumerate(spans):
        one = np.array([1.0, 0, 0, 0])
        for i in range(lo, hi):
            one = inertial.product(one, inertial.exponential(m @ ((gyr[i] + gyr[i + 1]) / 2 - b) * (t[i + 1] - t[i])))
        assert q[k] == pytest.approx(one, abs=1e-12)


def test_parameters_that_are_not_free_stay():
    x, cost = calibration.levenberg(lambda p: np.array([p[0] - 3, p[1] - 4]), np.array([1.0, 1.0]), free=[1])
    assert x == pytest.approx([1, 4]) and cost == pytest.approx(4)


# ---- thinning


def by_loop(xy, tolerance):
    keep, stack = {0, len(xy) - 1}, [(0, len(xy) - 1)]
    while stack:
        lo, hi = stack.pop()
        far, at = tolerance, None
        for i in range(lo + 1, hi):
            (x0, y0), (x1, y1), (x, y) = xy[lo], xy[hi], xy[i]
            c = math.hypot(x1 - x0, y1 - y0)
            d = abs((y1 - y0) * (x - x0) - (x1 - x0) * (y - y0)) / c if c > 0 else math.hypot(x - x0, y - y0)
            if d > far:
                far, at = d, i
        if at is not None:
            keep.add(at)
            stack += [(lo, at), (at, hi)]
    return keep


def test_thinning_equals_a_loop_for_any_tolerance_and_budget():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 40, 300):
        xy = np.cumsum(rng.normal(size=(n, 2)), axis=0)
        if n > 2:
            xy[-1] = xy[0]  # a closed track
        for tolerance in (0.1, 0.5, 2.0, 1e9):
            assert set(np.flatnonzero(thinning.significance(xy, [(0, n - 1)], tolerance) > 0)) == by_loop(xy, tolerance)
        for budget in (2, 5, 30):
            worth = thinning.significance(xy, [(0, n - 1)], 0.0, budget)
            kept = set(np.flatnonzero(worth > 0))
            assert len(kept) <= max(budget, 2)
            inner = worth[np.isfinite(worth) & (worth > 0)]
            if len(inner):  # all above the least that stays
                assert kept == by_loop(xy, np.nextafter(inner.min(), 0))


def test_thinning_a_million_points():
    t = np.linspace(0, 200 * np.pi, 1_000_000)
    xy = np.column_stack([t, 100 * np.sin(t)])
    began = time.time()
    worth = thinning.significance(xy, [(0, len(xy) - 1)], 0.0, 2000)
    kept = np.flatnonzero(worth > 0)
    assert 1000 < len(kept) <= 2000 and time.time() - began < 60
    assert np.abs(np.interp(xy[:, 0], xy[kept, 0], xy[kept, 1]) - xy[:, 1]).max() < 10


def test_breaks_of_a_track_stay(spark):
    rows = [("a", i, i, float(i), float(i % 7) if i not in (10, 11, 25) else None) for i in range(40)]
    out = thinning.thinned_track(spark.createDataFrame(rows, "recording_id string, t_us long, seq long, x double, y double"), "x", "y", tolerance=100.0)
    assert sorted(r.seq for r in out.collect()) == [0, 9, 12, 24, 26, 39]  # the ends of three parts


# ---- magnetic field


def potential(model, xyz, year):
    from numpy.polynomial import legendre

    r = np.linalg.norm(xyz)
    c, lon, total = xyz[2] / r, math.atan2(xyz[1], xyz[0]), 0.0
    g, h = model.at(np.array(year))
    for n in range(1, g.shape[0]):
        for m in range(n + 1):
            norm = math.sqrt(2 * math.factorial(n - m) / math.factorial(n + m)) if m else 1.0
            p = (1 - c * c) ** (m / 2) * legendre.legval(c, legendre.legder([0] * n + [1], m)) * norm
            total += magnetics.RADIUS * (magnetics.RADIUS / r) ** (n + 1) * (g[n, m] * math.cos(m * lon) + h[n, m] * math.sin(m * lon)) * p
    return total


@pytest.fixture(scope="module")
def twelve():
    """A model of degree twelve whose terms fall as the earth's do."""
    rng = np.random.default_rng(0)
    rows = [r for r in navigation.FIELD]
    rows += [(n, m, rng.normal() * 3000 / n**3, rng.normal() * 3000 / n**3 * (m > 0), rng.normal(), rng.normal() * (m > 0)) for n in range(3, 13) for m in range(n + 1)]
    return rows, magnetics.model(rows, 2020.0)


@pytest.mark.parametrize("lat, lon, height", [(0.7, -1.3, 5000.0), (-1.2, 3.0, 0.0), (0.0, 0.0, 100_000.0), (1.5, 0.4, 0.0)])
def test_field_is_the_gradient_of_the_potential(twelve, lat, lon, height):
    n = A / math.sqrt(1 - E2 * math.sin(lat) ** 2)
    p = np.array([(n + height) * math.cos(lat) * math.cos(lon), (n + height) * math.cos(lat) * math.sin(lon), (n * (1 - E2) + height) * math.sin(lat)])
    grad = -np.array([(potential(twelve[1], p + 10 * d, 2022.5) - potential(twelve[1], p - 10 * d, 2022.5)) / 20 for d in np.eye(3)])
    north, east = np.array([-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat)]), np.array([-math.sin(lon), math.cos(lon), 0])
    assert twelve[1].field(lat, lon, height, 2022.5)[0] == pytest.approx([grad @ north, grad @ east, grad @ np.cross(north, east)], abs=1e-3)


def test_at_a_dip_pole_the_field_is_vertical(twelve):
    at = twelve[1].dip_poles(2022.5)
    b = twelve[1].field(at[:, 0], at[:, 1], 0.0, 2022.5)
    assert np.hypot(b[:, 0], b[:, 1]).max() < 1e-3 and b[0, 2] > 0 > b[1, 2]


def test_coefficients_are_read_as_published(spark, twelve, tmp_path):
    lines = ["    2020.0            WMM-TEST          01/01/2020", *(f"{n:3d}{m:3d}{g:10.1f}{h:10.1f}{a:11.1f}{b:9.1f}" for n, m, g, h, a, b in twelve[0]), "9" * 48, "9" * 48]
    (tmp_path / "model.cof").write_text("\n".join(lines))
    read = magnetics.read_coefficients(spark, str(tmp_path / "model.cof"))
    assert read.epoch == 2020.0 and read.g == pytest.approx(twelve[1].g, abs=0.051) and read.dh == pytest.approx(twelve[1].dh, abs=0.051)


def test_headings_near_a_dip_pole_are_not_valid(spark, twelve):
    lat, lon = twelve[1].dip_poles(2022.5)[0]
    rows = [(1, float(lat), float(lon), 0.0, 2022.5), (2, float(lat) - 0.3, float(lon), 0.0, 2022.5), (3, None, 0.0, 0.0, 2022.5)]
    out = {r.k: r for r in magnetics.magnetic_elements(spark.createDataFrame(rows, "k long, lat double, lon double, height double, year double"), twelve[1]).collect()}
    assert out[1].pole_distance == pytest.approx(0, abs=1e-3) and not out[1].heading_valid and out[1].inclination == pytest.approx(90, abs=1e-3)
    assert out[2].heading_valid and out[2].pole_distance == pytest.approx(math.degrees(0.3), abs=0.01)
    assert out[3].heading_valid is None
