"""Blocks of recordings that step together against the same recordings one by one."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from driftline.operators import filters, fleet, inertial, lockstep, modes, stillness, suite, suites


def drives(lengths, seed=1):
    """Recordings of these lengths one after another, with all kinds of measurements now and then; gaps and a clock that goes back."""
    rng = np.random.default_rng(seed)
    n = sum(lengths)
    now = lambda share, x: np.where(rng.random(n) < share, x, np.nan)
    t = np.concatenate([np.cumsum(rng.choice([10_000, 20_000, 90_000, 1_500_000], k, p=[0.4, 0.5, 0.09, 0.01])) for k in lengths])
    df = pd.DataFrame({"recording_id": np.repeat(np.arange(len(lengths)), lengths), "t_us": t, "seq": np.arange(n)})
    for c in inertial.IMU:
        df[c] = rng.normal(0, 0.3, n) - 9.81 * (c == "acc_z")
    fix, vel = now(0.3, 1.0), now(0.2, 1.0)
    for c in (*inertial.FIX, *inertial.VEL):
        df[c] = rng.normal(0, 3.0, n) * (fix if c in inertial.FIX else vel)
    for c in (*inertial.FIX_VAR, *inertial.VEL_VAR):
        df[c] = 0.5 * (fix if c in inertial.FIX_VAR else vel)
    some = now(0.4, 0.1)
    df[inertial.FIX_COV] = np.stack([some, -some, some], 1)
    df["fix_age_s"] = now(0.8, rng.choice([0.0, 0.05, 0.2, 0.7], n))
    df["yaw"], df["yaw_var"], df["baro_h"], df["baro_var"] = now(0.1, 0.4), 0.1, now(0.2, rng.normal(0, 1, n)), 1.0
    df["speed"], df["speed_var"], df["speed_age_s"] = now(0.2, 2.0), 0.1, now(0.5, 0.1)
    df["sideways"], df["still"] = now(0.05, 1.0), now(0.05, 1.0)
    return df


def test_inertial_filters_that_step_together_equal_single_ones(monkeypatch):
    df, arm = drives([70, 1, 150, 40]), np.array([0.5, -0.2, 0.1])
    start, calls = np.array([0, 70, 71, 221]), []
    predict = fleet.Fleet.predict
    monkeypatch.setattr(fleet.Fleet, "predict", lambda self, *a: (calls.append(1), predict(self, *a)))
    got = fleet.filtered(df, start, arm, {})
    assert len(calls) == 150  # a step for the longest recording's rows, not for each row
    for _, own in df.groupby("recording_id"):
        k, rows = inertial.Inertial(), inertial.measured_rows(own)
        for i, (at, t) in enumerate(zip(own.index, own["t_us"], strict=True)):
            m = rows(i)
            if i == 0:
                k.begin(m)
            k.predict(int(t), m.imu[:3], m.imu[3:])
            inertial.correct(k, m, arm, arm)
            want = np.concatenate([k.p, k.v, k.rpy(), np.sqrt(np.diag(k.cov)[:3])])
            assert np.array([got[c][at] for c in ("n", "e", "d", "vn", "ve", "vd", "roll", "pitch", "yaw", "sd_n", "sd_e", "sd_d")]) == pytest.approx(want, rel=1e-7, abs=1e-7)


def test_blocks_are_whole_recordings():
    ids = [None] * 3 + [1] * 40 + [2] * 2 + [3] * 5
    batches = pa.table({"recording_id": pa.array(ids, pa.int64()), "seq": pa.array(range(50))}).to_batches(max_chunksize=4)
    out = list(lockstep.blocks(iter(batches), 8))
    assert [s for t, _ in out for s in t["seq"].to_pylist()] == list(range(50)) and len(out) > 1
    seen = [set(t["recording_id"].to_pylist()) for t, _ in out]
    assert sum(map(len, seen)) == 4 and all(t["recording_id"][int(k)].as_py() != t["recording_id"][int(k) - 1].as_py() for t, start in out for k in start[1:])
    assert [(j.tolist(), i.tolist()) for j, i in lockstep.steps(np.array([0, 1, 4]), 6)] == [([1, 2, 0], [1, 4, 0]), ([1, 2], [2, 5]), ([1], [3])]


def test_suites_that_step_together_equal_single_ones(monkeypatch):
    """Pressures, fields, losses of samples and of quality, outages, yaws and an arm: each recording as by the suite alone."""
    df = drives([400, 3, 900, 700, 900], seed=4)
    rng = np.random.default_rng(6)
    n, rec = len(df), df["recording_id"].to_numpy()
    df["t_us"] = df.groupby("recording_id").cumcount() * 20_000
    df[inertial.IMU] = rng.normal(0, 0.002, (n, 6)) + np.array([0, 0, 0, 0, 0, -9.81])
    for c in (*inertial.FIX, *inertial.VEL):
        df[c] *= 0.1
    df["pressure"] = np.where(rng.random(n) < 0.4, 101_325 + rng.normal(0, 3, n), np.where(rng.random(n) < 0.05, 1.0, np.nan))
    df[["mag_x", "mag_y", "mag_z"]] = np.where(((rec % 2 == 0) & (rng.random(n) < 0.3))[:, None], np.array([20.0, 1.0, 45.0]) + rng.normal(0, 0.5, (n, 3)), np.nan)
    k = df.groupby("recording_id").cumcount()
    df.loc[(rec == 2) & k.between(300, 330), inertial.IMU] = np.nan  # samples are lost
    df.loc[(rec == 3) & k.between(200, 290), [*inertial.FIX, *inertial.VEL]] = np.nan  # an outage
    df.loc[(rec == 4) & k.between(400, 700), inertial.FIX_VAR] = 400.0  # bad aiding
    df.loc[(rec == 2) & (k > 500), "yaw"] = np.nan
    df.loc[rec >= 3, "yaw"] = np.nan
    make = lambda: suite.Suite(arm=(0.5, -0.2, 0.1), gate=modes.Gate(dwell_s=0.4, gap_s=1.0, coast_s=0.5, fresh_s=0.1, stop_s=1.0, least_hz=2.0), level=stillness.LevelWindow(window_s=0.08))
    start, calls = np.flatnonzero(np.r_[True, rec[1:] != rec[:-1]]), []
    step = suites.Suites.step
    monkeypatch.setattr(suites.Suites, "step", lambda self, *a: (calls.append(1), step(self, *a))[1])
    got = suites.tracked(df.drop(columns="recording_id"), start, make())
    assert len(calls) == 900
    seen, names = set(), [c.split()[0] for c in suite.OUT.split(", ")]
    for _, own in df.groupby("recording_id"):
        one = make()
        for at, m in zip(own.index, suite.epochs(own), strict=True):
            want = one.step(m)
            seen |= {want["event"], want["attitude_source"], want["height_source"], want["ellipsoid_source"]}
            assert [got[c][at] for c in names[:5]] == [want[c] for c in names[:5]], (at, want)
            assert np.array([got[c][at] for c in names[5:]], float) == pytest.approx(np.array([want[c] for c in names[5:]], float), rel=1e-6, abs=1e-6, nan_ok=True)
    print(seen)
    assert seen >= {"imu_loss", "enter", "quality_loss", "reacquire", "ars", "ahrs", "ins", "vertical", "offset"}


@pytest.mark.parametrize("kind", ["stillness", "vertical", "smoother"])
def test_tracks_equal_loops_and_step_together(spark, monkeypatch, kind):
    """The columns of 40 recordings, and that a task steps its block, not its rows."""
    df = drives([int(k) for k in np.random.default_rng(8).integers(1, 60, 40)], seed=9)[["recording_id", "t_us", "seq", *inertial.IMU, "speed", "baro_h"]]
    df[inertial.IMU] = np.where(df["recording_id"].to_numpy()[:, None] % 2, df[inertial.IMU], np.random.default_rng(1).normal(0, 1e-4, (len(df), 6)) + np.array([0, 0, 0, 0, 0, -9.81]))
    frame = spark.createDataFrame(df.astype(object).where(df.notna(), None), "recording_id long, t_us long, seq long, " + ", ".join(f"{c} double" for c in df.columns[3:]))
    if kind == "stillness":
        out, names = stillness.stillness_track(frame, least=3, speed_age_s=0.1), ["active", "due"]
    else:
        out, names = filters.vertical_filter(frame, "acc_x", "baro_h", smooth=kind == "smoother"), ["h", "v", "bias"]
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()  # a group of pandas for each recording before
    got = out.toPandas().set_index("seq")[names]
    for _, own in df.groupby("recording_id"):
        if kind == "stillness":
            k, want = stillness.Still(least=3, speed_age_s=0.1), []
            for r in own.itertuples():
                due = k.step(r.t_us, np.array([r.gyr_x, r.gyr_y, r.gyr_z]), np.array([r.acc_x, r.acc_y, r.acc_z]), speed=None if np.isnan(r.speed) else r.speed)
                want.append((k.active, due))
            assert got.loc[own["seq"]].to_numpy().tolist() == [list(w) for w in want]
            continue
        k, last, parts = filters.Vertical(), None, [[] for _ in range(5)]
        for r in own.itertuples():
            dt = 0.0 if last is None else max(r.t_us - last, 0) / 1e6
            last = r.t_us
            k.predict(r.t_us, r.acc_x)
            before = k.x, k.p
            if r.baro_h == r.baro_h:
                k.height(r.baro_h)
            for part, x in zip(parts, (np.array([[1, dt, dt * dt / 2], [0, 1, dt], [0, 0, 1]]), before[1], k.p, before[0], k.x), strict=True):
                part.append(x)
        f, pb, pa, xb, xa = map(np.array, parts)
        want = filters.smoothed(f[1:], pb, pa, xb, xa)[0] if kind == "smoother" else xa
        assert got.loc[own["seq"]].to_numpy() == pytest.approx(want, rel=1e-7, abs=1e-7)
    if kind == "stillness":
        assert got["active"].any() and got["due"].any() and not got["active"].all()
