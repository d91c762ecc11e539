"""Queries on copies of the tables, and what their plans hold."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import clocks
from driftline.plans import navigation
from tests.oracle import same


@pytest.fixture(scope="module")
def twice(sf_dir, tmp_path_factory):
    """Every event three times, under keys of its own: times of a user come again."""
    out = tmp_path_factory.mktemp("twice")
    duckdb.sql(f"COPY (SELECT e.* REPLACE (event_id + c * 1000003 AS event_id, value + c * 0.25 AS value) FROM '{sf_dir}/events.parquet' e, range(3) t(c)) TO '{out}/events.parquet' (FORMAT parquet)")
    return str(out)


def test_gps_clock_counts_pairs_at_one_time_as_its_sql_does(spark, twice):
    same(navigation.gps_clock(spark, twice), navigation.GPS_CLOCK, twice)


def test_clocks_are_fitted_within_the_weeks(spark):
    t = F.col("id") * 60_000_000
    pairs = spark.range(50).select(F.lit("r").alias("recording_id"), t.alias("timesync_t_us"), F.lit(2200).alias("gps_week"), (F.lit(604_000.0) + t * 1e-6 * 1.00002 + 0.1).alias("gps_tow_s"))
    later = pairs.select("recording_id", "timesync_t_us", (F.col("gps_week") + (F.col("gps_tow_s") >= 604_800).cast("int")).alias("gps_week"), F.pmod("gps_tow_s", F.lit(604_800.0)).alias("gps_tow_s"))
    for df in (pairs, later):  # the weeks change in between
        r = clocks.gps_clocks(df).first()
        assert r.n == 50 and r.week == 2200 and r.a_s == pytest.approx(604_000.1, abs=1e-8) and r.a == pytest.approx(2200 * 604_800 + 604_000.1, abs=1e-6)


def test_decoded_messages_equal_field_by_field(spark):
    from driftline.sources import frames

    rng = np.random.default_rng(2)
    sizes = [0, 4, 8, 24, 27, 28, 30, 38, 44, 92, 100, 120]
    rows = [(i, bytes(rng.integers(0, 256, sizes[i % len(sizes)], np.uint8))) for i in range(240)] + [(240, None)]
    df = spark.createDataFrame(rows, "i int, p binary")
    p, f, r = F.col("p"), frames.field, frames.real
    when = lambda n, c: F.when(F.length("p") == n, c)
    pairs = [
        (frames.timesync(p)["t_us"], when(28, f(p, 0, 8))), (frames.timesync(p)["q_err_ps"], when(28, f(p, 20, 4, True))), (frames.odometry(p)["stddev_mps"], when(30, r(p, 20))),
        (frames.imu_sample(p)["gyr_y"], when(38, r(p, 24) * 0.017453292519943295)), (frames.imu_sample(p)["seq16"], when(38, f(p, 36, 2))), (frames.mag_sample(p)["temp_c"], when(24, r(p, 20))),
        (frames.saturation(p)["mask"], when(8, f(p, 6, 1))), (frames.nav_pvt(p)["height_m"], F.when(F.length("p") >= 92, f(p, 32, 4, True) * 1e-3)), (frames.nav_pvt(p)["sacc_mps"], F.when(F.length("p") >= 92, f(p, 68, 4) * 1e-3)),
        (frames.solution(p)["imu_hz"], when(120, f(p, 6, 2))), (frames.solution(p)["arm_d"], when(120, r(p, 92))), (F.when(F.expr("true"), frames.solution(p)["lat_deg"]), when(120, F.when(frames.bit(f(p, 8, 4), 6), r(p, 96, 8)))),
        (frames.counters(p)["imu_overruns"], F.when(F.length("p") % 4 == 0, f(p, 4, 4))), (F.get(frames.counters(p)["extra"], F.lit(0)), F.when(F.length("p") % 4 == 0, f(p, 40, 4))),
    ]
    out = df.select("i", *(c.alias(f"{side}{k}") for k, pair in enumerate(pairs) for side, c in zip("ab", pair, strict=True))).toPandas()
    for k in range(len(pairs)):
        assert out[f"a{k}"].to_numpy(float) == pytest.approx(out[f"b{k}"].to_numpy(float), rel=1e-15, nan_ok=True), k
        assert out[f"a{k}"].notna().any(), k


@pytest.mark.parametrize("name", ["device_messages", "position_messages", "setting_items"])
def test_messages_are_not_decoded_by_strings(spark, sf_dir, name):
    """A conversion of text for each number of each row took 0.1 ms a row."""
    plan = scalars_plan(spark, sf_dir, name)
    assert plan.count("conv(") <= 2 and "ArrowEvalPython" in plan


def scalars_plan(spark, sf_dir, name):
    from driftline.plans import scalars

    return getattr(scalars, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_long_payloads_of_items_take_time_by_their_length(spark):
    from driftline.sources import frames

    body = b"".join((0x4000_0000 + k).to_bytes(4, "little") + k.to_bytes(4, "little") for k in range(2000))
    df = spark.range(200, numPartitions=1).select(F.lit(b"\x00\x01\x01\x00" + body).alias("p"), "id")
    began = time.perf_counter()
    row = df.select(F.size(frames.value_items(F.col("p"))["items"]).alias("n"), F.element_at(frames.value_items(F.col("p"))["items"], -1).alias("last")).groupBy("n", "last").count().collect()
    assert [(r.n, r["last"].key, r["last"].value, r["count"]) for r in row] == [(2000, 0x4000_0000 + 1999, (1999).to_bytes(4, "little"), 200)]
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("name", ["stream_metrics", "stream_findings"])
def test_streams_are_read_once_for_each_kind_of_metric(spark, sf_dir, name):
    """14 scans of the events for metrics and 36 for findings before."""
    plan = getattr(navigation, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 4 and "FlatMapGroups" not in plan


def test_rates_with_empty_buckets(spark):
    from driftline.operators import diagnosis

    times = {"even": [0, 1, 2, 3], "gaps": [0, 0, 0, 4, 4, 7, 9], "one": [0], "two": [0, 0, 1], "zeros": [0, 9, 20]}
    rows = [(r, int(t * 1e6)) for r, own in times.items() for t in own]
    got = {r.recording_id: r.spread for r in diagnosis.rate_spread(spark.createDataFrame(rows, "recording_id string, t_us long"), 1.0).collect()}
    for r, own in times.items():
        last = max(own)
        hz = sorted(own.count(b) for b in range(last if last >= 2 else last + 1))
        middle = hz[len(hz) // 2]
        assert got[r] == pytest.approx((hz[-1] - hz[0]) / middle if middle else 0.0), r
