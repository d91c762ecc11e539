import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import filters, inertial, suite
from driftline.sources.streams import events
from driftline.streaming import estimators, stateful
from tests.test_inertial import as_frame, drive


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = events(spark, sf_dir).select("recording_id", "t_us", "seq", "value").where("recording_id < 20")
    half = rows.approxQuantile("t_us", [0.5], 0.0)[0]
    src = str(tmp_path / "src")
    rows.where(F.col("t_us") <= half).coalesce(1).write.parquet(src)

    def run():
        df = spark.readStream.schema(rows.schema).parquet(src)
        q = estimators.offset_stream(df, 1e-4, 25.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    rows.where(F.col("t_us") > half).coalesce(1).write.mode("append").parquet(src)
    run()
    got = {(r.recording_id, r.seq): r.estimate for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.recording_id, r.seq): r.estimate for r in filters.offset_filter(rows, 1e-4, 25.0).collect()}
    assert got == want


def test_rates(spark, sf_dir):
    rows = events(spark, sf_dir)
    assert estimators.rates(rows).agg(F.sum("n")).first()[0] == rows.count()


# ---- filters with their state kept by Spark


def in_batches(frame, cuts, tmp_path, query, spark):
    """The query's rows when the frame comes in several batches, with a restart from the checkpoint before each."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = frame.where((F.lit(True) if lo is None else F.col("t_us") > lo) & (F.lit(True) if hi is None else F.col("t_us") <= hi))
        part.coalesce(1).write.mode("append").parquet(src)
        q = query(spark.readStream.schema(frame.schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def equal(stream, batch, columns):
    values = lambda df: {(r.recording_id, r.seq): [np.nan if r[c] is None else r[c] for c in columns] for r in df.collect()}
    got, want = values(stream), values(batch)
    assert got.keys() == want.keys() and len(got) > 0
    for k, row in want.items():
        assert got[k] == pytest.approx(row, rel=1e-9, abs=1e-9, nan_ok=True), k


@pytest.fixture(scope="module")
def sensors(spark, tmp_path_factory):
    """Two drives with an outage, late fixes and pressure."""
    path, frames = str(tmp_path_factory.mktemp("drives") / "rows"), []
    for n, seed in enumerate((1, 2)):
        df, *_ = drive(16, rate=25, seed=seed)
        df.loc[(df.t_us > 9e6) & (df.t_us < 13e6), inertial.FIX] = np.nan
        df["recording_id"], df["pressure"] = f"r{n}", 101325 * (1 - 50 / 44330) ** 5.255
        df["fix_age_s"] = np.where(df.seq % 50 == 0, 0.1, 0.0)
        frames.append(df)
    df = pd.concat(frames)
    as_frame(spark, df).write.parquet(path)
    return spark.read.parquet(path)


def test_vertical_stream_equals_batch_over_restarts(spark, sf_dir, tmp_path):
    rows = events(spark, sf_dir).where("recording_id < 20").withColumns({"acc": (F.col("value") - 50) * 1e-9, "height": F.when(F.col("stream") == "view", F.col("value"))})
    rows = rows.select("recording_id", "t_us", "seq", "acc", "height")
    cuts = rows.approxQuantile("t_us", [0.3, 0.6], 0.0)
    stream = in_batches(rows, cuts, tmp_path, lambda df: stateful.stateful(df, stateful.vertical_kernel("acc", "height")), spark)
    equal(stream, filters.vertical_filter(rows, "acc", "height"), ["h", "v", "bias"])


def test_attitude_stream_equals_batch_over_restarts(spark, sensors, tmp_path):
    stream = in_batches(sensors, [5_000_000, 11_000_000], tmp_path, lambda df: stateful.stateful(df, stateful.attitude_kernel()), spark)
    equal(stream, filters.attitude_filter(sensors), ["roll", "pitch", "yaw"])


def test_inertial_stream_equals_batch_over_restarts(spark, sensors, tmp_path):
    # The cut lies between a fix and its arrival: the ring of past states has to come through the checkpoint.
    stream = in_batches(sensors, [3_980_000, 7_980_000], tmp_path, lambda df: stateful.stateful(df, stateful.inertial_kernel()), spark)
    equal(stream, inertial.inertial_filter(sensors), ["n", "e", "d", "vn", "ve", "vd", "roll", "pitch", "yaw", "sd_n"])


def test_suite_stream_equals_batch_over_restarts(spark, sensors, tmp_path):
    gate = {"dwell_s": 2.0, "coast_s": 2.0, "fresh_s": 1.5}
    stream = in_batches(sensors, [4_000_000, 10_000_000], tmp_path, lambda df: stateful.stateful(df, stateful.suite_kernel(gate)), spark)
    batch = suite.suite_track(sensors, gate)
    equal(stream, batch, ["roll", "pitch", "yaw", "height", "ellipsoid", "n", "e", "d"])
    named = lambda df: {(r.recording_id, r.seq): (r.mode, r.event, r.attitude_source, r.height_source, r.ellipsoid_source) for r in df.collect()}
    assert named(stream) == named(batch)
    assert {r.event for r in batch.select("event").distinct().collect()} >= {None, "enter", "reacquire"}


def test_restarts_late_rows_and_idle_recordings(spark, tmp_path):
    batches = [
        [("a", 1_000_000, 0, 0.0, 1.0), ("a", 2_000_000, 1, 0.0, 1.0), ("b", 1_500_000, 0, 0.0, 5.0)],
        [("a", 1_900_000, 2, 0.0, 1.0), ("a", 3_000_000, 3, 0.0, 1.0)],  # late by 0.1 s
        [("a", 400_000, 4, 0.0, 9.0), ("a", 500_000, 5, 0.0, 9.0)],  # the device started again
        [("c", 90_000_000, 0, 0.0, 1.0)],
        [("c", 91_000_000, 1, 0.0, 1.0)],
    ]
    schema, src, out = "recording_id string, t_us long, seq long, acc double, height double", str(tmp_path / "s"), str(tmp_path / "o")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        df = spark.readStream.schema(schema).parquet(src)
        stateful.stateful(df, stateful.vertical_kernel("acc", "height"), idle_s=30.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).collect()
    at = {(r.recording_id, r.seq): r for r in got if not r.idle}
    assert ("a", 2) not in at and at["a", 3].late == 1 and at["a", 3].segment == 0
    assert at["a", 4].segment == 1 and at["a", 5].segment == 1
    assert at["a", 4].h == pytest.approx(10 / 9)  # a new filter at 0, to which 9 is an outlier
    assert {r.recording_id for r in got if r.idle} == {"a", "b"}
