"""The recording's clock against GPS time, and the gyros' bias at its start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions import geo, rotation
from driftline.operators.signal import line_fit

#: Seconds of a week; bits of a pair's flags: on the grid of UTC, in doubt; how far a pair may lie off the line (s).
WEEK_S, UTC_BASE, SUSPECT, REJECT_S = 604_800, 1 << 1, 1 << 4, 0.5


def gps_clocks(pairs: DataFrame, once: bool = True, rounds: int = 5) -> DataFrame:
    """recording_id, a, b (GPS seconds are a + b * t_us), n, rejected, utc_pairs, segments, ppm, week and a_s.

    a_s is a without the seconds up to the recording's first week: a double holds GPS seconds to 0.2 us only, and the line is
    fitted within the weeks.

    pairs: recording_id, timesync_t_us, gps_week, gps_tow_s and, if there, flags and mcu_restarts. Pairs in doubt or without a
    time go; with `once`, one that is repeated counts once. A restart begins a clock of its own: the segment with the most pairs is taken, the
    first of equals. Pairs over REJECT_S off the line go and it is fitted again, up to `rounds` times; of one pair only the offset is known.
    """
    has = set(pairs.columns)
    flags = F.coalesce(F.col("flags"), F.lit(0)) if "flags" in has else F.lit(0)
    part = F.coalesce(F.col("mcu_restarts"), F.lit(0)) if "mcu_restarts" in has else F.lit(0)
    gps = F.col("gps_week") * WEEK_S + F.col("gps_tow_s")
    own = pairs.withColumns({"__flags": flags, "__part": part, "__gps": gps}).where(F.col("timesync_t_us").isNotNull() & F.col("__gps").isNotNull() & (F.col("__flags").bitwiseAND(SUSPECT) == 0))
    time, utc = F.struct("__gps", F.col("gps_week").alias("week"), F.col("gps_tow_s").alias("tow")), F.col("__flags").bitwiseAND(UTC_BASE)
    if once:
        rows = own.groupBy("recording_id", "__part", F.col("timesync_t_us").alias("t_us")).agg(F.max(time).alias("time"), F.min(utc).alias("utc"))
    else:
        rows = own.select("recording_id", "__part", F.col("timesync_t_us").alias("t_us"), time.alias("time"), utc.alias("utc"))
    week = F.min("time.week").over(W.partitionBy("recording_id"))
    rows = rows.withColumn("week", week).withColumn("gps", (F.col("time.week") - F.col("week")) * WEEK_S + F.col("time.tow")).drop("time")
    each = W.partitionBy("recording_id", "__part")
    rows = rows.withColumns({"n0": F.count(F.lit(1)).over(each), "utc_pairs": F.sum((F.col("utc") > 0).cast("long")).over(each)})
    rows = rows.withColumn("r", F.dense_rank().over(W.partitionBy("recording_id").orderBy(F.desc("n0"), "__part"))).withColumn("segments", F.size(F.collect_set("__part").over(W.partitionBy("recording_id"))).cast("long"))
    chosen = rows.where("r = 1")
    fit = line_fit(chosen, ["recording_id"], "t_us", "gps", REJECT_S, rounds)
    sums = chosen.groupBy("recording_id").agg(F.first("n0").alias("n0"), F.max("utc_pairs").alias("utc_pairs"), F.max("segments").alias("segments"), F.min("week").alias("week"), F.avg("t_us").alias("mt"), F.avg("gps").alias("mg"))
    # Where a line cannot be fitted (one pair, or all at one time), the rate is taken as right.
    known = F.col("b").isNotNull()
    out = sums.join(fit, "recording_id", "left").withColumn("a_s", F.when(known, F.col("a")).otherwise(F.col("mg") - 1e-6 * F.col("mt")))
    return out.select(
        "recording_id", (F.col("a_s") + F.col("week") * WEEK_S).alias("a"), F.coalesce("b", F.lit(1e-6)).alias("b"), F.when(known, F.col("n")).otherwise(F.col("n0")).alias("n"),
        (F.col("n0") - F.when(known, F.col("n")).otherwise(F.col("n0"))).alias("rejected"), "utc_pairs", "segments", F.when(known, (1 / (F.col("b") * 1e6) - 1) * 1e6).otherwise(0.0).alias("ppm"), "week", "a_s",
    )


def median_latency(fixes: DataFrame, clocks: DataFrame) -> DataFrame:
    """recording_id, latency_ms: the median of what fixes arrive after their own GPS time; fixes without one do not count."""
    at = F.when(F.col("gps_week") > 0, (F.col("t_us") - (F.col("gps_week") * WEEK_S + F.col("gps_tow_s") - F.col("a")) / F.col("b")) / 1e3)
    return fixes.join(clocks.select("recording_id", "a", "b"), "recording_id").groupBy("recording_id").agg(F.median(at).alias("latency_ms")).where(F.col("latency_ms").isNotNull())


def initial_gyro_bias(imu: DataFrame, truth: DataFrame, window_s: float = 3.0) -> DataFrame:
    """recording_id, n and bias_x, bias_y, bias_z: the mean rate of the first window less the earth's and the journey's rate and the platform's own turn.

    truth: recording_id, t_us, lat (radians), h, vn, ve, roll, pitch, yaw; its first row in the window gives attitude and place, and
    that row and the last one in the window give the turn, where they are over half a second apart.
    """
    first = F.min("t_us").over(W.partitionBy("recording_id"))
    own = imu.withColumn("from", first).where(F.col("t_us") - F.col("from") <= window_s * 1e6).groupBy("recording_id")
    mean = own.agg(F.count(F.lit(1)).alias("n"), F.first("from").alias("from"), *(F.avg(f"gyr_{a}").alias(f"g{a}") for a in "xyz"))
    row = F.struct("t_us", "lat", "h", "vn", "ve", "roll", "pitch", "yaw")
    near = truth.join(mean.select("recording_id", "from"), "recording_id").where((F.col("t_us") >= F.col("from")) & (F.col("t_us") <= F.col("from") + int(window_s * 1e6)))
    ends = near.groupBy("recording_id").agg(F.min_by(row, "t_us").alias("p"), F.max_by(row, "t_us").alias("q"))
    j = mean.join(ends, "recording_id")
    quat = lambda s: rotation.from_rpy(F.col(f"{s}.roll"), F.col(f"{s}.pitch"), F.col(f"{s}.yaw"))
    p = quat("p")
    to_body = rotation.conjugate(p)
    rate = geo.navigation_rate(F.col("p.lat"), F.col("p.h"), F.col("p.vn"), F.col("p.ve"))
    nav = rotation.turned(rotation.to_matrix(to_body), rate)
    span = (F.col("q.t_us") - F.col("p.t_us")) / 1e6
    turn = rotation.rotation_vector(rotation.multiply(to_body, quat("q")))
    part = lambda k: F.when(span > 0.5, turn[k] / span).otherwise(0.0)
    bias: list[Column] = [(F.col(f"g{a}") - nav[k] - part(k)).alias(f"bias_{a}") for k, a in enumerate("xyz")]
    return j.select("recording_id", "n", *bias)
