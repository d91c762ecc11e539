"""Faults, scores, mounting, items of keys and values, and folders of recordings."""

import collections
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import faults, mounting, scoring
from driftline.sources import frames, recordings


# ---- faults


@pytest.fixture(scope="module")
def runs(spark):
    """Fixes at 1 Hz and truth of two recordings of 900 s that move from 10 s on."""
    rows = [(r, k * 1_000_000, k, 48.0, 8.0, 100.0, 0.01, 0.0, 0.0, 0.01, 0.0, 0.04, 1.0 if k >= 10 else 0.0, 0.0, 0.0) for r in ("a", "b") for k in range(900)]
    return spark.createDataFrame(rows, "recording_id string, t_us long, seq long, lat_deg double, lon_deg double, h_m double, p_nn double, p_ne double, p_nd double, p_ee double, p_ed double, p_dd double, vn double, ve double, vd double")


def as_set(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("kind", faults.KINDS)
def test_faults_keep_their_schedule_and_sizes(runs, kind):
    mods = faults.fault_mods(runs, runs, kind)
    assert as_set(mods) == as_set(faults.fault_mods(runs.repartition(7), runs.repartition(3), kind))
    one = as_set(faults.fault_mods(runs.where("recording_id = 'a'"), runs.where("recording_id = 'a'"), kind))
    assert one == {r for r in as_set(mods) if r[0] == "a"}  # the other recording does not matter
    assert as_set(faults.fault_mods(runs, runs, kind, seed=2)) != as_set(mods)
    period = 300 if kind in ("step", "big_step") else 90
    rows = [r for r in mods.collect() if r.recording_id == "a"]
    by_event = collections.Counter(r.event for r in rows)
    assert sorted(by_event) == list(range(math.ceil((899 - 90 - 130) / period)))
    for r in rows:
        s = r.t_us / 1e6 - 130 - r.event * period
        flat = math.hypot(r.dn, r.de)
        if kind == "spike":
            assert s in (0, 3, 6) and 5 <= flat <= 50 and abs(r.dd) <= flat and r.sd_h is None
        elif kind == "vel_spike":
            assert s in (0, 3, 6) and flat == 0 and 1 <= math.hypot(r.dvn, r.dve) <= 5
        elif kind == "gross":
            assert 0 <= s <= 31 and flat == pytest.approx(500)
        elif kind in ("step", "big_step"):
            assert 0 <= s < 150 and (0.5 <= flat <= 2 if kind == "step" else 5 <= flat <= 10)
        elif kind in ("wrong_fix", "multipath"):
            assert 0 <= s < 30 and (0.5 <= flat <= 3 if kind == "wrong_fix" else 3 <= flat <= 15) and (r.sd_h is None) == (kind == "wrong_fix")
        else:
            assert 0 <= s < 30 and (r.sd_h, r.sd_v) == (1.0, 2.0)
    whole = {"spike": 3, "vel_spike": 3, "step": 150, "big_step": 150, "degraded": 30}.get(kind)
    if whole:
        assert set(by_event.values()) <= {whole, 899 - 130 - 600 + 1} and by_event[0] == whole
    elif kind == "gross":
        assert all(1 <= n <= 3 for n in by_event.values())
    else:
        assert all(5 <= n <= 30 for n in by_event.values())
        for e in by_event:  # one offset for a whole event
            assert len({(r.dn, r.de, r.dd) for r in rows if r.event == e}) == 1


def test_point_errors_are_correlated_in_time(runs):
    rows = faults.point_mods(runs.repartition(5)).orderBy("recording_id", "t_us").toPandas()
    assert len(rows) == 1800
    for _, own in rows.groupby("recording_id"):
        x = own.dn.to_numpy()
        assert 0.7 < x.std() < 3 and np.corrcoef(x[1:], x[:-1])[0, 1] == pytest.approx(math.exp(-1 / 30), abs=0.05)
    a, b = (rows[rows.recording_id == r].dn.to_numpy() for r in "ab")
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.6


def test_scenarios_add_up_and_apply(runs):
    mods = faults.scenario(runs, runs, "multipath", point=True)
    point, fault = {(r.recording_id, r.t_us): r for r in faults.point_mods(runs).collect()}, {(r.recording_id, r.t_us): r for r in faults.fault_mods(runs, runs, "multipath").collect()}
    for r in mods.collect():
        k = (r.recording_id, r.t_us)
        assert r.dn == pytest.approx(point[k].dn + (fault[k].dn if k in fault else 0)) and (r.sd_h, r.sd_v) == (1.5, 3.0)
        assert r.kind == ("multipath" if k in fault else "point")
    out = faults.modified(runs, faults.fault_mods(runs, runs, "multipath")).orderBy("recording_id", "t_us").collect()
    assert len(out) == 1800 and out[0].asDict().keys() == runs.first().asDict().keys()
    for r in out:
        f = fault.get((r.recording_id, r.t_us))
        north = (r.lat_deg - 48) * 111_200
        assert (r.p_nn, r.p_dd) == ((1.0, 4.0) if f else (0.01, 0.04)) and north == pytest.approx(f.dn if f else 0, abs=0.05)
    assert {n for n, *_ in faults.SCENARIOS} >= {*faults.KINDS, "point", "point_gross"}
    with pytest.raises(ValueError):
        faults.fault_mods(runs, runs, "no such kind")


# ---- scores


def test_scores_equal_a_loop(spark):
    rng = np.random.default_rng(0)
    names = [*scoring.POSITION, *scoring.VELOCITY, *scoring.ANGLES]
    schema = "recording_id string, t_us long, seq long, " + ", ".join(f"{n} double" for n in names)
    t_track, t_truth = np.sort(rng.integers(0, 60_000_000, 300)), np.sort(rng.integers(0, 60_000_000, 80))
    track, truth = rng.normal(size=(300, 9)), rng.normal(size=(80, 9))
    track[:, 8] *= 3  # yaws that go round
    t_track[100:] += 3_000_000  # a gap over which angles are not interpolated
    make = lambda t, x: spark.createDataFrame([("r", int(a), i, *map(float, y)) for i, (a, y) in enumerate(zip(t, x))], schema)
    e = scoring.errors(make(t_track, track), make(t_truth, truth), delay_us=2000)
    want = {}
    for i, (t, b) in enumerate(zip(t_truth - 2000, truth)):
        k = int(np.searchsorted(t_track, t))
        if k == len(t_track):
            continue
        age, x = t_track[k] - t, track[k]
        gap = t_track[k] - t_track[k - 1] if k else 0
        w = age / gap if 0 < gap <= 1_000_000 else 0.0
        wrap = lambda a: (a + math.pi) % (2 * math.pi) - math.pi
        pos = [x[c] - x[c + 3] * age / 1e6 - b[c] for c in range(3)]
        ang = [wrap(x[c] + (w * wrap(track[k - 1][c] - x[c]) if w else 0) - b[c]) for c in (6, 7, 8)]
        want[i] = [*pos, *(x[c] - b[c] for c in (3, 4, 5)), *ang]
    got = {r.seq: [r[n] for n in names] for r in e.collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-9)
    s = {r.metric: r.value for r in scoring.score(e, 10.0, to_s=50.0).collect()}
    start = min(t_truth[i] - 2000 for i in want)
    own = np.array([want[i] for i in want if 10e6 <= t_truth[i] - 2000 - start < 50e6])
    sec = np.array([(t_truth[i] - 2000 - start) / 1e6 for i in want if 10e6 <= t_truth[i] - 2000 - start < 50e6])
    deg = np.degrees(own[:, 6:])
    assert s["epochs"] == len(own) and s["pos_rms_m"] == pytest.approx(math.sqrt((own[:, :3] ** 2).sum(1).mean())) and s["pos_max_m"] == pytest.approx(np.linalg.norm(own[:, :3], axis=1).max())
    assert s["att_bias_deg"] == pytest.approx(np.abs(deg[:, :2].mean(0)).max()) and s["att_std_deg"] == pytest.approx(deg[:, :2].std(0).max())
    assert s["yaw_std_deg"] == pytest.approx(deg[:, 2].std()) and s["yaw_drift_deg_min"] == pytest.approx(np.polyfit(sec / 60, deg[:, 2], 1)[0])


def test_coasting_errors(spark):
    e = spark.createDataFrame([("r", k * 1_000_000, k, 0.5 * k, 0.0, 0.1 * k) for k in range(60)], "recording_id string, t_us long, seq long, n double, e double, d double")
    aiding = spark.createDataFrame([("r", k * 1_000_000) for k in range(60) if not 20 < k < 40], "recording_id string, t_us long")
    (r,) = scoring.coasting(e, aiding, 5.0).collect()
    assert (r.t0_us, r.t1_us) == (20_000_000, 40_000_000) and r.horizontal_m == pytest.approx(10.0) and r.vertical_m == pytest.approx(2.0)
    assert scoring.coasting(e, aiding, 5.0, warmup_s=30.0).count() == 0


# ---- mounting


def rotation(rng, size):
    from driftline.operators.filters import Attitude

    k = Attitude()
    k.q = k.exponential(rng.normal(size=3) * size)
    return k.matrix()


def test_housing_rotations_are_recovered(spark):
    rng, rows, true = np.random.default_rng(1), [], {}
    for name, faces in {"all": list(mounting.FACES), "two": ["bottom", "nose"], "tilt": ["bottom", "top"], "one": ["left"]}.items():
        true[name] = rotation(rng, 0.1)
        for f in faces:
            v = true[name].T @ np.array(mounting.FACES[f]) * 9.8 + rng.normal(0, 0.005, 3)
            rows.append((name, f, *map(float, v)))
    rows.append(("all", "no such face", 1.0, 0.0, 0.0))
    df = spark.createDataFrame(rows, "recording_id string, face string, acc_x double, acc_y double, acc_z double")
    out = {r.recording_id: r for r in mounting.housing_rotations(df).collect()}
    assert set(out) == set(true) and out["all"].placements == 6
    for name in ("all", "two"):
        assert np.array(out[name].matrix).reshape(3, 3) == pytest.approx(true[name], abs=3e-3) and not out[name].tilt_only and out[name].residual_deg < 0.2
    for name in ("tilt", "one"):  # the turn about the vertical is not known
        m = np.array(out[name].matrix).reshape(3, 3)
        axis = np.array(mounting.FACES["left" if name == "one" else "bottom"])
        assert out[name].tilt_only and m @ true[name].T @ axis == pytest.approx(axis, abs=3e-3)
    face, angle = mounting.nearest_face()
    near = {r.face: (r.found, r.a) for r in df.where("recording_id = 'all'").select("face", face.alias("found"), angle.alias("a")).collect()}
    assert all(near[f][0] == f and near[f][1] < 20 for f in mounting.FACES)


def test_dip_alignment_is_recovered(spark):
    rng, rows, true = np.random.default_rng(2), [], {}
    for name, n in (("r1", 12), ("r2", 20), ("few", 4)):
        true[name] = rotation(rng, 0.08)
        field, down = np.array([20.0, 0, 45.0]), np.array([0, 0, 9.8])
        for _ in range(n):
            body = rotation(rng, 1.5)
            a, m = -body.T @ down, true[name].T @ (body.T @ field)
            rows.append((name, *map(float, a + rng.normal(0, 0.002, 3)), *map(float, m + rng.normal(0, 0.02, 3))))
    df = spark.createDataFrame(rows, "recording_id string, acc_x double, acc_y double, acc_z double, mag_x double, mag_y double, mag_z double").repartition(3)
    out = {r.recording_id: r for r in mounting.dip_alignments(df).collect()}
    assert set(out) == {"r1", "r2"}
    for name, r in out.items():
        assert np.array(r.matrix).reshape(3, 3) == pytest.approx(true[name], abs=5e-3)
        assert r.dip_deg == pytest.approx(math.degrees(math.atan2(45, 20)), abs=0.2) and r.scatter_after_deg < 0.2 < r.scatter_before_deg and r.observability > 0.15


# ---- frames and folders


def items_by_loop(payload):
    if len(payload) < 4:
        return None
    out, at = [], 4
    while at < len(payload):
        if len(payload) - at < 4:
            return None
        (key,) = struct.unpack_from("<I", payload, at)
        at += 4
        width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}.get(key >> 28 & 7)
        if width is None:
            if len(payload) - at < 2:
                return None
            (width,) = struct.unpack_from("<H", payload, at)
            at += 2
        if len(payload) - at < width:
            return None
        out.append((key, payload[at : at + width]))
        at += width
    return out


def test_value_items_equal_a_loop(spark):
    rng = np.random.default_rng(3)
    payloads = [b"", b"abc", bytes(4), bytes([1, 2, 1, 0])]
    for _ in range(200):
        p = bytes(rng.integers(0, 3, 4, dtype=np.uint8))
        for _ in range(int(rng.integers(0, 6))):
            kind = int(rng.integers(0, 8))
            width = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}.get(kind)
            p += struct.pack("<I", kind << 28 | int(rng.integers(0, 1 << 28)))
            if width is None:
                width = int(rng.integers(0, 9))
                p += struct.pack("<H", width)
            p += bytes(rng.integers(0, 256, width, dtype=np.uint8))
        payloads.append(p[: len(p) - int(rng.integers(0, 3))] if rng.random() < 0.3 else p)
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "i long, payload binary")
    got = {r.i: r for r in df.select("i", *(c.alias(n) for n, c in frames.value_items(F.col("payload")).items())).collect()}
    for i, p in enumerate(payloads):
        want = items_by_loop(p)
        assert (None if got[i]["items"] is None else [(x.key, bytes(x.value)) for x in got[i]["items"]]) == want, p
        if len(p) >= 4:
            assert got[i].layer == p[1] and got[i].more == (p[2] > 0)


def test_inertial_and_magnetic_samples(spark):
    imu, mag = struct.pack("<Q6fIH", 123_456_789_012, 0.5, -1, 1, 10, -20, 30, 0x7FF | 3 << 11, 65_000), struct.pack("<Q4f", 5, 20, -1.5, 44, 31.25)
    df = spark.createDataFrame([(bytearray(imu), bytearray(mag)), (bytearray(b"xx"), bytearray(b""))], "i binary, m binary")
    a, b = df.select(F.struct(*(c.alias(n) for n, c in frames.imu_sample(F.col("i")).items())).alias("i"), F.struct(*(c.alias(n) for n, c in frames.mag_sample(F.col("m")).items())).alias("m")).collect()
    assert (a.i.t_us, a.i.seq16, a.i.status_temp, a.i.status_flags) == (123_456_789_012, 65_000, -1, 3)
    assert (a.i.acc_x, a.i.acc_y, a.i.gyr_z) == pytest.approx((0.5 * 9.80665, -9.80665, math.radians(30)))
    assert (a.m.t_us, a.m.mag_x, a.m.mag_z, a.m.temp_c) == (5, 20, 44, 31.25)
    assert b.i.t_us is None and b.m.mag_x is None


def test_a_folder_of_recordings_is_one_source(spark, tmp_path):
    pytest.importorskip("yaml")
    for r, start in (("one", 1_000_000), ("two", -5_000_000)):
        d = tmp_path / r
        d.mkdir()
        (d / "imu.csv").write_text("# t\n" + "".join(f"{start + k * 100_000},0,0,0,0,0,-9.8\n" for k in range(100)))
        cov = ["0,0,0,0,0,0", "1,0,0,1,0,4"]
        (d / "gnss.csv").write_text("".join(f"{start + k * 1_000_000},48,8,100,{cov[k % 2]},1,0,0,0,0,0,0,0,0,1\n" for k in range(10)))
        (d / "ref.csv").write_text(f"{start},48,8,100,1,2,3,0,0,0\n")
    (tmp_path / "one" / "config.yaml").write_text("aiding: gnss\ngnss:\n  delay_ms: 200\nscore:\n  ref_delay_ms: 30\n  lim_pos_rms_m: 0.5\nspeed:\n")
    config = recordings.settings(spark, str(tmp_path / "one"))
    assert config["gnss"]["delay_ms"] == 200 and config["gnss"]["vel_stddev_fallback_mps"] == 0.5 and config["speed"]["scale"] == 1.0
    assert recordings.limits(config, "one") == [("one", "pos_rms_m", 0.5)]
    out = recordings.read_recordings(spark, str(tmp_path), [(2.0, 3.0)], config)
    assert set(out) == {"imu", "gnss", "ref"} and out["imu"].count() == 200
    fixes = out["gnss"].orderBy("recording_id", "t_us").collect()
    assert [(r.t_us - {"one": 1_000_000, "two": -5_000_000}[r.recording_id]) // 1_000_000 for r in fixes] == [0, 1, 5, 6, 7, 8, 9] * 2
    assert (fixes[0].p_nn, fixes[0].p_dd, fixes[1].p_dd, fixes[0].v_nn, fixes[0].age_us) == (25.0, 100.0, 4.0, 0.25, 200_000)
    assert sorted(r.t_us for r in out["ref"].collect()) == [-5_030_000, 970_000]
    with pytest.raises(ValueError):
        recordings.read_recordings(spark, str(tmp_path / "one"))


# ---- from a folder to scores and findings


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A recording of a circle with all its streams, fixes 0.1 s late, as files."""
    from tests.test_inertial import drive
    from driftline.operators import inertial

    df, pos, vel, yaw = drive(40, rate=50)
    root = tmp_path_factory.mktemp("dataset")
    d = root / "circle"
    d.mkdir()
    lat0, h0 = 0.8, 300.0
    n = 6378137.0 / math.sqrt(1 - 0.00669437999014 * math.sin(lat0) ** 2)
    m = n * (1 - 0.00669437999014) / (1 - 0.00669437999014 * math.sin(lat0) ** 2)
    place = lambda p: (float(math.degrees(lat0 + p[0] / (m + h0))), float(math.degrees(0.2 + p[1] / ((n + h0) * math.cos(lat0)))), float(h0 - p[2]))
    (d / "imu.csv").write_text("".join(",".join(map(repr, [int(r.t_us), r.gyr_x, r.gyr_y, r.gyr_z, r.acc_x, r.acc_y, r.acc_z])) + "\n" for r in df.itertuples()))
    rows, truth, baro, heading = [], [], [], []
    for i, r in enumerate(df.itertuples()):
        at = ",".join(map(repr, place(pos[i])))
        truth.append(f"{r.t_us},{at},0.0,0.0,{math.degrees(yaw[i])},{vel[i][0]},{vel[i][1]},0.0\n")
        if i % 50 == 0:
            fix = ",".join(map(repr, place([getattr(r, f) for f in inertial.FIX])))
            rows.append(f"{r.t_us + 100_000},{fix},0.25,0,0,0.25,0,0.25,{r.vel_n},{r.vel_e},{r.vel_d},0.0025,0,0,0.0025,0,0.0025,1\n")
            heading.append(f"{r.t_us},{math.degrees(yaw[i])},2.0,2,1.0,0\n")
        if i % 10 == 0:
            baro.append(f"{r.t_us},{101325 * (1 - h0 / 44330) ** 5.255!r}\n")
    for name, lines in (("gnss", rows), ("ref", truth), ("baro", baro), ("heading", heading)):
        (d / f"{name}.csv").write_text("".join(lines))
    (d / "config.yaml").write_text("aiding: gnss\ngnss:\n  delay_ms: 100\nscore:\n  warmup_sec: 8.0\n  lim_pos_rms_m: 1.0\n  lim_yaw_bias_deg: 3.0\n  lim_att_std_deg: 0.001\n")
    return str(root)


def test_a_folder_goes_through_to_its_limits(spark, folder):
    pytest.importorskip("yaml")
    from driftline.operators import replay

    config = recordings.settings(spark, f"{folder}/circle")
    streams = recordings.read_recordings(spark, folder, config=config)
    assert set(streams) == {"imu", "gnss", "ref", "baro", "heading"}
    track, scores = replay.replayed(streams, config)
    limits = spark.createDataFrame(recordings.limits(config, "circle"), "recording_id string, metric string, limit double")
    out = {r.metric: r for r in scoring.judged(scores, limits).collect()}
    assert out["pos_rms_m"].passed and 0.1 < out["pos_rms_m"].value < 1.0 and out["yaw_bias_deg"].passed
    assert not out["att_std_deg"].passed  # a limit that no filter keeps
    late = dict(config, gnss=dict(config["gnss"], delay_ms=0.0))
    worse = {r.metric: r.value for r in replay.replayed(recordings.read_recordings(spark, folder, config=late), late)[1].collect()}
    assert worse["pos_rms_m"] > out["pos_rms_m"].value  # 100 ms at 5 m/s
    assert track.count() == 2000 and track.where("mode = 3").count() > 1000


def test_findings_of_a_folder(spark, folder):
    pytest.importorskip("yaml")
    from driftline.operators import diagnosis, doctor

    config = recordings.settings(spark, f"{folder}/circle")
    found = {r.rule: (r.severity, r.text) for r in doctor.told(diagnosis.metrics(recordings.read_recordings(spark, folder, config=config), config), ["recording_id"]).collect()}
    assert found["imu_continuous"] == (0, "samples at 50 Hz without a gap over 20 ms")
    assert found["gnss_coverage"] == (0, "40 fixes, at most 1.0 s apart")
    assert found["gnss_sigma_unchecked"][0] == 1 and "accel_scale" not in found and "gnss_few_fixes" not in found
    assert all(text and "null" not in text for _, text in found.values())


def test_every_rule_with_a_text_exists():
    from driftline.operators import doctor

    rules = {r for g in doctor.GROUPS for r, *_ in g}
    assert set(doctor.TEXTS) <= rules


def test_findings_query_has_numbers(spark, sf_dir):
    from driftline.plans import navigation

    rows = navigation.stream_findings(spark, sf_dir).collect()
    assert {r.rule for r in rows} >= {"imu_dropout", "gnss_sigma_unchecked"} and all("null" not in r.text for r in rows)


# ---- conditioning and text sinks


def test_blocks_that_cannot_be_go_as_a_whole(spark):
    from driftline.operators import conditioning

    good = {"gyr_x": 0.1, "gyr_y": 0.0, "gyr_z": 0.0, "acc_x": 0.0, "acc_y": 0.0, "acc_z": -9.8, "fix_n": 1.0, "fix_e": 2.0, "fix_d": 3.0, "fix_var_n": 1.0, "fix_var_e": 1.0, "fix_var_d": 1.0, "fix_age_s": 0.1, "yaw": 4.0, "yaw_var": 0.1, "pressure": 1e5, "fix_cov_ne": 0.1}
    cases = [{}, {"gyr_x": math.nan}, {"acc_z": 2e4}, {"fix_e": math.inf}, {"fix_var_d": 0.0}, {"fix_age_s": 0.6}, {"yaw": 7.0}, {"yaw_var": math.nan}, {"pressure": 5.0}, {"fix_cov_ne": math.nan}, {"pressure": None}]
    rows = [{**good, **c, "k": i} for i, c in enumerate(cases)]
    out = [r.asDict() for r in conditioning.sanitized(spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} double" for c in good) + ", k long")).orderBy("k").collect()]
    assert out[0]["yaw"] == pytest.approx(4.0 - 2 * math.pi) and {c: out[0][c] for c in good if c != "yaw"} == {c: v for c, v in good.items() if c != "yaw"}
    gone = [{c for c in good if r[c] is None} for r in out]
    imu, fix = {"gyr_x", "gyr_y", "gyr_z", "acc_x", "acc_y", "acc_z"}, {f"fix_{v}{a}" for a in "ned" for v in ("", "var_")}
    assert gone == [set(), imu, imu, fix, fix, fix, {"yaw", "yaw_var"}, {"yaw", "yaw_var"}, {"pressure"}, set(), {"pressure"}]
    assert out[9]["fix_cov_ne"] == 0.0


def test_chi_square_thresholds():
    from driftline.operators.conditioning import chi2_threshold

    # Quantiles as tables print them.
    for p, x in ((0.5, 0.4549), (0.9, 2.7055), (0.95, 3.8415), (0.99, 6.6349), (0.999, 10.8276), (0.99999, 19.5114)):
        assert chi2_threshold(p) == pytest.approx(x, abs=1e-4)
    assert chi2_threshold(0.1) == chi2_threshold(math.nan) == chi2_threshold(0.5) and chi2_threshold(1.0) == pytest.approx(29.396, abs=0.06)


def test_acceleration_of_an_antenna_and_its_noise(spark):
    from driftline.functions import rotation
    from driftline.operators import conditioning

    rng = np.random.default_rng(5)
    a, w, l = rng.normal(size=3), rng.normal(size=3), rng.normal(size=3)
    lit = lambda v: tuple(F.lit(float(x)) for x in v)
    eye = [[F.lit(float(i == k)) for k in range(3)] for i in range(3)]
    acc = conditioning.antenna_acceleration(lit(a), eye, lit(w), lit(l))
    row = spark.range(1).select(*(c.alias(f"a{i}") for i, c in enumerate(acc)), *(c.alias(f"v{i}") for i, c in enumerate(conditioning.manoeuvre_variance(acc, 0.2, 0.5)))).first()
    want = a + np.cross(w, np.cross(w, l))
    assert [row[f"a{i}"] for i in range(3)] == pytest.approx(want.tolist())
    flat = 0.04 * (want[0] ** 2 + want[1] ** 2)
    assert [row[f"v{i}"] for i in range(3)] == pytest.approx([flat, flat, 0.25 * want[2] ** 2])


def test_a_prior_that_rest_contradicts(spark):
    from driftline.operators import conditioning

    rows = [("r", p, p * 100_000_000 + k * 50_000, 0.001 if p else 0.02, 0.0, 0.0, 0.0, 0.0, -9.80665 - 0.3 * p) for p in (0, 1) for k in range(500)]
    df = spark.createDataFrame(rows, "recording_id string, phase long, t_us long, gyr_x double, gyr_y double, gyr_z double, acc_x double, acc_y double, acc_z double")
    out = {(r.phase, r.t0_us): (r.n, r.acc_exceeded, r.gyr_exceeded) for r in conditioning.bias_prior(df, 0.05, 0.002).collect()}
    assert out == {(0, 0): (200, False, True), (0, 10_000_000): (200, False, True), (1, 100_000_000): (200, True, False), (1, 110_000_000): (200, True, False)}


def test_streams_are_written_and_read_again(spark, runs, tmp_path):
    from driftline.sources import sinks
    from driftline.sources.streams import read_stream

    # What a filter needs of fixes; the rest of the columns in between is 0.
    some = runs.where("t_us < 50000000").withColumn("vel_ok", F.lit(1))
    sinks.write_stream(some, str(tmp_path / "out"), "gnss")
    back = read_stream(spark, str(tmp_path / "out" / "*"), "gnss")
    names = ["t_us", "lat_deg", "lon_deg", "h_m", "p_nn", "p_dd", "vn", "vel_ok"]
    got = sorted((r.recording_id.removeprefix("recording_id="), *(r[c] for c in names)) for r in back.collect())
    assert got == sorted((r.recording_id, *(r[c] for c in names)) for r in some.collect())


def test_tracks_are_written_row_by_row(spark, runs, tmp_path):
    import xml.etree.ElementTree as ET

    from driftline.sources import sinks

    some = runs.where("t_us < 30000000")
    for timed in (False, True):
        sinks.write_track(some, str(tmp_path / str(timed)), timed)
        for r in "ab":
            (file,) = (tmp_path / str(timed) / f"recording_id={r}").glob("*.txt")
            root = ET.fromstring(file.read_text())
            if timed:
                assert len(root.findall(".//{*}when")) == len(root.findall(".//{*}coord")) == 30
                assert root.find(".//{*}when").text == "1970-01-01T00:00:00.000000Z"
            else:
                assert root.find(".//{*}coordinates").text.split() == ["8.00000000,48.00000000,100.000"] * 30


# ---- clocks and the start


def test_clocks_of_recordings(spark):
    from driftline.operators import clocks

    line = lambda t: 2200 * 604_800 + 100.0 + t * 1.00001e-6
    pair = lambda r, t, off=0.0, flags=1, part=0: (r, t, 2200, line(t) + off - 2200 * 604_800, flags, part)
    rows = [pair("a", k * 60_000_000) for k in range(30)] + [pair("a", 0)] + [pair("a", 60_000_000 * 31, 1.0), pair("a", 5, 50.0, 17)]  # repeated, slipped, in doubt
    rows += [pair("a", k * 60_000_000, 9.0, 1, 1) for k in range(5)] + [pair("b", 7_000_000, 0.0, 3)] + [("c", None, 2200, 1.0, 1, 0)]
    out = {r.recording_id: r for r in clocks.gps_clocks(spark.createDataFrame(rows, "recording_id string, timesync_t_us long, gps_week int, gps_tow_s double, flags int, mcu_restarts int")).collect()}
    assert set(out) == {"a", "b"}
    a, b = out["a"], out["b"]
    assert (a.n, a.rejected, a.segments, a.utc_pairs) == (30, 1, 2, 0) and a.a + a.b * 6e8 == pytest.approx(line(6e8), abs=1e-4) and a.ppm == pytest.approx(-10.0, abs=0.01)
    assert (b.n, b.rejected, b.utc_pairs) == (1, 0, 1) and b.b == 1e-6 and b.a + 7 == pytest.approx(line(7e6), abs=1e-6) and b.ppm == 0.0
    fixes = spark.createDataFrame([("a", int(t * 1e6) + 80_000, 2200, line(t * 1e6) - 2200 * 604_800) for t in range(1, 6)] + [("a", 0, 0, 0.0)], "recording_id string, t_us long, gps_week int, gps_tow_s double")
    assert clocks.median_latency(fixes, spark.createDataFrame([a, b])).first().latency_ms == pytest.approx(80.0, abs=0.2)


def test_initial_gyro_bias_is_what_remains(spark):
    from driftline.operators import clocks, inertial

    lat, bias, turn = 0.8, np.array([0.001, -0.002, 0.003]), np.array([0.0, 0.0, 0.02])
    k = inertial.Inertial(lat=lat)
    k.level(np.array([1.0, 0.5, -9.7]), 0.7)
    earth = inertial.OMEGA_E * np.array([math.cos(lat), 0, -math.sin(lat)])
    imu, truth = [], []
    for i in range(401):
        t = i * 10_000
        truth.append(("r", t, lat, 0.0, 0.0, 0.0, *map(float, k.rpy())))
        imu.append(("r", t, i, *map(float, bias + turn + k.matrix().T @ earth)))
        k.q = inertial.product(k.q, inertial.exponential(turn * 0.01))
    out = clocks.initial_gyro_bias(spark.createDataFrame(imu, "recording_id string, t_us long, seq long, gyr_x double, gyr_y double, gyr_z double"), spark.createDataFrame(truth, "recording_id string, t_us long, lat double, h double, vn double, ve double, roll double, pitch double, yaw double")).first()
    assert out.n == 301 and [out.bias_x, out.bias_y, out.bias_z] == pytest.approx(bias.tolist(), abs=2e-6)
