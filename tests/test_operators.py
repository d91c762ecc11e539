import json
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import geo, rotation
from driftline.operators import align, calibration, faults, filters, quality, signal, windows
from driftline.sources import frames, sinks, streams


def stream(spark, rows):
    return spark.createDataFrame([(1, t, i, float(v)) for i, (t, v) in enumerate(rows)], "recording_id long, t_us long, seq long, value double")


def test_newest_only_uses_a_row_once_and_loses_older_ones(spark):
    base, aux = stream(spark, [(10, 0), (20, 0), (30, 0), (40, 0)]), stream(spark, [(1, 1), (5, 2), (20, 3), (21, 4), (25, 5), (41, 6)])
    got = [(r.t_us, r.aux_t_us, r.aux_value) for r in align.newest_only(base, aux).orderBy("t_us").collect()]
    assert got == [(10, 5, 2.0), (20, 20, 3.0), (30, 25, 5.0)]


def test_fifo_equals_a_loop(spark):
    rng = random.Random(4)
    base = sorted(rng.sample(range(1000), 12))
    aux = sorted(rng.choices(range(900), k=40))
    queue, taken, i = [], {}, 0
    for e, t in enumerate(base):
        while i < len(aux) and aux[i] <= t:
            queue.append(i)
            i += 1
        for k in queue[:4]:
            taken[k] = e
        queue = queue[4:]
    got = {r.seq: r.epoch for r in align.fifo(stream(spark, [(t, 0) for t in base]), stream(spark, [(t, 0) for t in aux])).collect()}
    assert got == taken


def test_gaps_of_one_row_and_of_equal_times(spark):
    r = quality.gap_statistics(stream(spark, [(5, 0)])).first()
    assert (r.n, r.duration_s, r.avg_hz, r.max_gap_s) == (1, 0.0, 0.0, 0.0)
    r = quality.gap_statistics(stream(spark, [(0, 0), (10, 0), (20, 0), (20, 0)])).first()
    assert (r.n, r.max_gap_s, r.max_gap_at_s) == (4, 1e-5, 1e-5)


def test_allan_deviation_equals_numpy(spark):
    x = np.random.default_rng(1).normal(size=200)
    got = {r.m: r.adev for r in signal.allan_deviation(stream(spark, list(enumerate(x))), 0.1, [1, 4, 50]).collect()}
    s = np.concatenate([[0], np.cumsum(x)]) * 0.1
    for m in (1, 4, 50):
        d = s[2 * m :] - 2 * s[m:-m] + s[: -2 * m]
        assert got[m] == pytest.approx(np.sqrt((d**2).sum() / (2 * (m * 0.1) ** 2 * len(d))))


def test_line_fit_leaves_out_what_is_far_off(spark):
    rows = [(1, float(k), 2.0 + 3.0 * k + (100.0 if k == 30 else 0.0)) for k in range(40)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    r = signal.line_fit(df, ["g"], "x", "y", reject=20.0).first()
    assert (r.n, round(r.a, 6), round(r.b, 6)) == (39, 2.0, 3.0)


def test_spans_end_at_the_first_row_that_is_off(spark):
    got = windows.spans(stream(spark, [(0, 1), (1, 1), (2, 0), (3, 1)]), F.col("value") > 0).orderBy("t0_us").collect()
    assert [(r.t0_us, r.t1_us) for r in got] == [(0, 2), (3, 3)]


def test_unwrapped_bridges_nulls(spark):
    df = stream(spark, [(0, 350), (1, 355), (2, 5), (3, 20)]).withColumn("value", F.when(F.col("t_us") != 1, F.col("value")))
    assert [r.unwrapped for r in windows.unwrapped(df).orderBy("t_us").collect()] == [350.0, None, 365.0, 380.0]


def test_rotation_and_position_roundtrips(spark):
    df = spark.createDataFrame([(0.3, -0.4, 2.0, 0.8, 0.2, 120.0)], "r double, p double, y double, lat double, lon double, h double")
    back = rotation.to_rpy(rotation.from_rpy(F.col("r"), F.col("p"), F.col("y")))
    place = geo.ecef_to_llh(*geo.llh_to_ecef(F.col("lat"), F.col("lon"), F.col("h")))
    assert df.select(*back, *place).first()[:] == pytest.approx((0.3, -0.4, 2.0, 0.8, 0.2, 120.0), abs=1e-7)


def test_frames_survive_noise_and_cuts(spark, tmp_path):
    rng = random.Random(2)
    sent = [(rng.randrange(256), rng.randrange(256), bytes(rng.randrange(256) for _ in range(rng.randrange(60)))) for _ in range(40)]
    data = b"".join(b"\x00\xb5" * rng.randrange(3) + frames.frame(*f) for f in sent)
    framer, got = frames.Framer(), []
    while data:
        n = rng.randrange(1, 30)
        got += framer.feed(data[:n])
        data = data[n:]
    assert got == sent
    (tmp_path / "a.bin").write_bytes(b"".join(frames.frame(*f) for f in sent))
    rows = frames.read_frames(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.cls, r.id, bytes(r.payload)) for r in rows] == sent
    r = spark.createDataFrame([(b"\x01\x02\xff\xff",)], "p binary").select(frames.field(F.col("p"), 0, 2), frames.field(F.col("p"), 2, 2, True), frames.field(F.col("p"), 3, 2)).first()
    assert r[:] == (513, -1, None)


def test_reader_drops_comments_and_short_rows(spark, tmp_path):
    (tmp_path / "rec1").mkdir()
    (tmp_path / "rec1" / "baro.csv").write_text("# t_us, p\n-5, 101325\n7\n\n9, 100000, 3\n11, nan\n12, x\n")
    rows = streams.read_stream(spark, str(tmp_path / "rec1" / "baro.csv"), "baro").orderBy("t_us").collect()
    assert [(r.recording_id, r.t_us, r.pressure_pa) for r in rows] == [("rec1", -5, 101325.0), ("rec1", 9, 100000.0), ("rec1", 11, None)]


def test_sinks(spark):
    df = spark.createDataFrame([("a", 1, 48.0, 11.0, float("nan"))], "recording_id string, t_us long, lat_deg double, lon_deg double, h_m double")
    assert json.loads(sinks.as_json(df).first().json) == {"recording_id": "a", "t_us": 1, "lat_deg": 48.0, "lon_deg": 11.0}
    assert spark.range(1).select(sinks.gps_time(F.lit(1e9 + 0.25))).first()[0] == "2011/09/14 01:46:40.250"


def test_ellipsoid_and_rotation_fits(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(800, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    m, b = np.array([[1.1, 0.05, 0], [0.05, 0.9, 0.02], [0, 0.02, 1.0]]), np.array([5.0, -3.0, 2.0])
    raw = v @ np.linalg.inv(m).T * 45 + b
    df = spark.createDataFrame([tuple(map(float, r)) for r in raw], "x double, y double, z double")
    fit, centre = calibration.ellipsoid(df, "x", "y", "z", 45.0)
    assert centre == pytest.approx(b, abs=1e-4)
    assert np.linalg.norm((raw - centre) @ fit.T, axis=1) == pytest.approx(45.0, abs=1e-3)
    r = calibration.shortest_rotation(np.array([1.0, 2, 3]), np.array([0.0, 0, 1]))
    df = spark.createDataFrame([tuple(map(float, (*a, *(r @ a)))) for a in v[:20]], "a double, b double, c double, d double, e double, f double")
    assert calibration.wahba(df, ("a", "b", "c"), ("d", "e", "f")) == pytest.approx(r, abs=1e-9)
    x, _ = calibration.levenberg(lambda p: np.array([p[0] - 3, 10 * (p[1] - p[0] ** 2)]), np.array([0.0, 0.0]))
    assert x == pytest.approx([3, 9], abs=1e-4)


def test_attitude_finds_a_constant_tilt_and_gyro_bias(spark):
    r = filters.Attitude()
    roll, g = 0.2, 9.80665
    acc = np.array([0, -np.sin(roll) * g, -np.cos(roll) * g])
    for k in range(20000):
        out = r.step(k * 10_000, np.array([0.002, 0, 0]), acc)
    assert out[:2] == pytest.approx([roll, 0], abs=1e-2)
    assert r.bias[0] == pytest.approx(0.002, abs=1e-3)


def test_smoother_is_nearer_than_the_filter(spark):
    rng = np.random.default_rng(5)
    t = np.arange(300)
    truth = 10 * np.sin(t / 30)
    acc = np.gradient(np.gradient(truth))
    rows = [(1, int(k * 1e6), int(k), float(acc[k]), float(truth[k] + rng.normal())) for k in t]
    df = spark.createDataFrame(rows, "recording_id long, t_us long, seq long, acc double, height double")
    error = lambda smooth: np.sqrt(np.mean((filters.vertical_filter(df, "acc", "height", smooth).orderBy("seq").toPandas()["h"].to_numpy() - truth) ** 2))
    assert error(True) < error(False) < 1.0


def test_tumbling_windows(spark):
    got = filters.tumbling_variance(stream(spark, [(k * 50_000, k) for k in range(20)]), 200_000).orderBy("t0_us").collect()
    assert [(r.t0_us, r.n, r.variance) for r in got] == [(0, 8, 6.0), (400_000, 8, 6.0)]


def test_faults_are_the_same_for_any_partitioning(spark):
    fixes = spark.range(200).select(F.lit("r").alias("recording_id"), (F.col("id") * 1_000_000).alias("t_us"), F.lit(48.0).alias("lat_deg"), F.lit(11.0).alias("lon_deg"), F.lit(500.0).alias("h_m"))
    mods = faults.merged(faults.jumps(fixes, 10, 50, 5, 100.0), faults.drift(fixes, 150, 0.5))
    one = faults.applied(fixes, mods).orderBy("t_us").collect()
    two = faults.applied(fixes.repartition(7), mods.repartition(3)).orderBy("t_us").collect()
    assert one == two
    moved = [r for r in one if r.lat_deg != 48.0 or r.lon_deg != 11.0]
    assert len(moved) == 4 * 5 + 49 - 5  # five fixes have both


def test_long_recording_joins_in_linear_time(spark):
    """One recording of 500,000 rows: running windows both ways, no frame that is gone through again for each row."""
    n = 500_000
    base = spark.range(n).select(F.lit("r").alias("recording_id"), (F.col("id") * 10_000).alias("t_us"), F.col("id").alias("seq"), F.col("id").cast("double").alias("value"))
    aux = spark.range(n // 100).select(F.lit("r").alias("recording_id"), (F.col("id") * 1_000_000 + 3_000).alias("t_us"), F.col("id").alias("seq"), F.col("id").cast("double").alias("value"))
    began = time.perf_counter()
    assert align.nearest(base, aux, 10**9).where("aux_t_us is not null").count() == n
    assert align.interpolated(base, aux, 10**9).where("aux_value is not null").count() == n - 100
    assert align.newest_only(base, aux).count() == n // 100
    assert time.perf_counter() - began < 60


def test_filters_take_the_ids_of_a_stream_that_was_read(spark, tmp_path):
    folder = tmp_path / "run7"
    folder.mkdir()
    (folder / "baro.csv").write_text("# t_us,pressure\n" + "".join(f"{k * 10_000},{101325 - k}\n" for k in range(60)))
    s = streams.read_stream(spark, str(folder / "baro.csv"), "baro").withColumnRenamed("pressure_pa", "value").withColumn("acc", F.lit(0.1))
    for out in (filters.offset_filter(s, 1e-4, 1.0), filters.vertical_filter(s, "acc", "value", smooth=True), filters.greedy_thinned(s, 50_000), filters.tumbling_variance(s, 100_000)):
        rows = out.collect()
        assert rows and {r.recording_id for r in rows} == {"run7"}


def test_messages_of_packed_structures(spark):
    v = [1, 3, 1, 1, 0b100001, 37, 200, (1 << 18) - 1 - (1 << 9), 812, *(np.arange(20) * 1.25 - 7).tolist(), 48.1234567, -11.7654321, 49.5, -3.25]
    packed = {
        "solution": struct.pack("<BBBBBBHII6f3f3f5f3fdd2f", *v),
        "odometry": struct.pack("<QQffHHH", 1 << 50, 77, 12.5, 0.25, 40, 0b10011, 1),
        "timesync": struct.pack("<QIIIiHH", 123456789, 5, 345600000, 1 << 31, -250, 2300, 0b11001),
        "counters": struct.pack("<12I", *range(4_000_000_000, 4_000_000_012)),
        "saturation": struct.pack("<3H2B", 65535, 3, 5, 0b001010, 1),
    }
    for name, body in packed.items():
        df = spark.createDataFrame([(bytearray(body),), (bytearray(body[:-1]),), (None,)], "p binary")
        got = [r.asDict() for r in df.select(*(c.alias(n) for n, c in getattr(frames, name)(F.col("p")).items())).collect()]
        assert all(x is None or x == [] for r in got[1:] for x in r.values())
        packed[name] = got[0]
    s = packed["solution"]
    assert (s["mode"], s["att_src"], s["sat_axes"], s["imu_hz"], s["cpu_pct"]) == ("full", "ins", ["acc_x", "gyr_z"], 200, 37)
    assert (s["roll"], s["vz"], s["arm_d"], s["lat_deg"], s["lon_deg"], s["mag_decl_deg"]) == (-7.0, 13.0, 16.75, 48.1234567, -11.7654321, -3.25)
    assert s["baro_alt"] is None and s["baro_meas"] == 11.75 and s["ready"] and s["vzupt"]
    o = packed["odometry"]
    assert (o["t_unix_us"], o["t_us"], o["speed_mps"], o["stddev_mps"], o["delay_ms"], o["t_us_valid"], o["reverse"]) == (1 << 50, 77, 12.5, 0.25, 40, True, True)
    t = packed["timesync"]
    assert (t["t_us"], t["q_err_ps"], t["gps_valid"], t["utc_base"], t["suspect"]) == (123456789, -250, True, False, True)
    assert t["gps_s"] == pytest.approx(2300 * 604800 + 345600.0005 - 250e-12, abs=1e-9)
    c = packed["counters"]
    assert c["tx_dropped"] == 4_000_000_000 and c["gnss_crc_errors"] == 4_000_000_009 and c["extra"] == [4_000_000_010, 4_000_000_011]
    assert packed["saturation"] == {"first_seq": 65535, "last_seq": 3, "samples": 5, "mask": 10, "axes": ["acc_y", "gyr_x"], "flags": 1, "dropped_before": True}


def test_rotation_fit_counts_directions_only(spark):
    rng = np.random.default_rng(4)
    r = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    r *= np.sign(np.linalg.det(r))
    a = rng.normal(size=(40, 3))
    b = a @ r.T * rng.uniform(0.1, 9, size=(40, 1))
    df = spark.createDataFrame([tuple(map(float, [*x, *y])) for x, y in zip(a, b)], "a double, b double, c double, d double, e double, f double")
    assert calibration.wahba(df, ("a", "b", "c"), ("d", "e", "f")) == pytest.approx(r, abs=1e-9)


def test_left_out_columns_of_a_fix_are_zero(spark, tmp_path):
    folder = tmp_path / "run8"
    folder.mkdir()
    (folder / "gnss.csv").write_text("5," + ",".join(["1.5"] * 18) + ",1\n")
    r = streams.read_stream(spark, str(folder / "gnss.csv"), "gnss").first()
    assert (r.quality, r.gps_week, r.gps_tow_s, r.num_sv, r.nav_auth) == (0, 0, 0.0, 0, 0)


def test_vertical_smoother_query_equals_a_loop(spark, sf_dir):
    from driftline.plans import streams

    got = {(r.recording_id, r.seq): (r.h, r.v, r.bias) for r in streams.vertical_smoother(spark, sf_dir).collect()}
    rows = streams.events(spark, sf_dir).withColumns({"acc": (F.col("value") - 50) * 1e-9, "height": F.when(F.col("stream") == "view", F.col("value"))}).toPandas()
    assert len(got) == len(rows)
    for rec, own in list(rows.groupby("recording_id"))[:4]:
        own = own.sort_values(["t_us", "seq"])
        k, steps, last = filters.Vertical(), [], None
        for t, a, z in zip(own.t_us, own.acc, own.height):
            dt = 0.0 if last is None else (t - last) / 1e6
            last = t
            k.predict(int(t), float(a))
            before = (k.x.copy(), k.p.copy())
            if z == z:
                k.height(float(z))
            steps.append((np.array([[1, dt, dt * dt / 2], [0, 1, dt], [0, 0, 1]]), *before, k.x.copy(), k.p.copy()))
        x, want = steps[-1][3], [steps[-1][3]]
        for (_, _, _, xa, pa), (f, xb, pb, _, _) in zip(reversed(steps[:-1]), reversed(steps[1:])):
            x = xa + pa @ f.T @ np.linalg.solve(pb, x - xb)
            want.append(x)
        for seq, w in zip(own.seq, reversed(want)):
            assert got[rec, seq] == pytest.approx(tuple(w), rel=1e-5, abs=1e-4)
