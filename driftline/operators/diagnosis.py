"""The metrics of a recording's findings from its streams; operators/doctor.py says what they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions import geo
from driftline.operators import clocks, quality, stillness

#: States of a receiver's indicators from which on it warns, and of an authentication that failed.
WARNED, FAILED = 2, 2


def rate_spread(df: DataFrame, bucket_s: float = 5.0) -> DataFrame:
    """recording_id, spread: greatest less least rate over buckets, by their upper median; the last bucket, which is not whole, does not count where there are three."""
    start = W.partitionBy("recording_id")
    bucket = ((F.col("t_us") - F.min("t_us").over(start)) / 1e6 / bucket_s).cast("long")
    counts = df.select("recording_id", bucket.alias("bucket")).groupBy("recording_id", "bucket").agg((F.count(F.lit(1)) / bucket_s).alias("hz"))
    core = counts.withColumn("last", F.max("bucket").over(start)).where((F.col("bucket") < F.col("last")) | (F.col("last") < 2))
    ranks = core.withColumns({"m": F.col("last") + (F.col("last") < 2).cast("long"), "some": F.count(F.lit(1)).over(start), "r": F.row_number().over(start.orderBy("hz")) - 1})
    # Empty buckets, m - some of them, come before all others.
    empty = F.col("m") - F.col("some")
    g = ranks.groupBy("recording_id").agg(F.max(F.when(F.col("r") == F.floor(F.col("m") / 2) - empty, F.col("hz"))).alias("middle"), F.max("hz").alias("most"), F.min(F.when(empty > 0, 0.0).otherwise(F.col("hz"))).alias("least"))
    return g.select("recording_id", F.when(F.col("middle") > 0, (F.col("most") - F.col("least")) / F.col("middle")).otherwise(0.0).alias("spread"))


def noise_ratio(columns: list[str], psd: float) -> tuple[Column, Column]:
    """Of rows of quality.gaps_and_noise: the worst axis's noise floor by what a density makes of it at the recording's rate, and whether any is band-limited."""
    worst, limited = (F.greatest(*(f"{k}_{c}" for c in columns)) for k in ("noise", "limited"))
    return worst**2 / F.nullif(F.col("avg_hz") * psd, F.lit(0.0)), limited


def metrics(streams: dict[str, DataFrame], config: dict, gyr_psd: float = 1e-7, acc_psd: float = 1e-4, least_still: int = 100, max_gap_us: int = 100_000, bucket_s: float = 5.0) -> DataFrame:
    """A row for each recording with inertial samples: what doctor.report reads, as far as the streams tell. The samples are read for gaps and noise, rates, and rest; the fixes once."""
    imu = streams["imu"]
    axes = {n: [f"{n}_{a}" for a in "xyz"] for n in ("gyr", "acc")}
    gaps = quality.gaps_and_noise(imu.select("recording_id", "t_us", "seq", *axes["gyr"], *axes["acc"]), [*axes["gyr"], *axes["acc"]], max_gap_us)
    (gyr, gyr_limited), (acc, acc_limited) = noise_ratio(axes["gyr"], gyr_psd), noise_ratio(axes["acc"], acc_psd)
    out = gaps.select(
        "recording_id", F.col("avg_hz").alias("imu_hz"), F.col("max_gap_s").alias("imu_max_gap"), F.col("max_gap_at_s").alias("imu_max_gap_at"),
        gyr.alias("gyr_noise_ratio"), gyr_limited.alias("gyr_band_limited"), acc.alias("acc_noise_ratio"), acc_limited.alias("acc_band_limited"),
    )
    out = out.join(rate_spread(imu.select("recording_id", "t_us"), bucket_s).withColumnRenamed("spread", "imu_rate_spread"), "recording_id", "left")
    still = stillness.stillness_track(imu, also=tuple(axes["acc"])).where("active")
    norm = still.select("recording_id", F.sqrt(sum((F.col(c) ** 2 for c in axes["acc"]), F.lit(0.0))).alias("norm"))
    middle = quality.order_statistics(norm, ["recording_id"], "norm").where(F.col("n") >= least_still)
    out = out.join(middle.select("recording_id", F.col("median").alias("__norm")), "recording_id", "left")
    place = F.lit(9.80665)
    if "gnss" in streams:
        fixes = streams["gnss"]
        bad = lambda c, least: F.when(F.max(c) > 0, F.sum((F.col(c) >= least).cast("long")))  # noqa: E731  all 0: the receiver does not tell
        told = quality.gaps_and_noise(
            fixes, [], max_gap_us, F.min_by(F.struct("lat_deg", "h_m"), F.struct("t_us", "seq")).alias("__o"),
            bad("jamming", WARNED).alias("jamming_bad"), bad("spoofing", WARNED).alias("spoofing_bad"), F.when(F.max("sig_auth") > 0, F.sum((F.col("sig_auth") == FAILED).cast("long"))).alias("sig_auth_failed"),
            F.when(F.max("nav_auth") > 0, F.sum((F.col("nav_auth") == FAILED).cast("long"))).alias("nav_auth_failed"), F.avg(F.when(F.col("vel_ok") > 0, F.sqrt((F.col("v_nn") + F.col("v_ee")) / 2))).alias("gnss_hor_mps"),
            F.percentile(F.when(F.col("num_sv") > 0, F.col("num_sv")), F.lit(0.5)).alias("satellites"), F.min(F.when(F.col("num_sv") > 0, F.col("num_sv"))).alias("least_satellites"),
        ).drop("duration_s", "avg_hz", "max_gap_at_s").withColumnsRenamed({"n": "gnss_n", "max_gap_s": "gnss_max_gap"})
        if "timesync" in streams:
            out = out.join(clocks.median_latency(fixes, clocks.gps_clocks(streams["timesync"])), "recording_id", "left")
        out = out.join(told, "recording_id", "left").withColumn("gnss_n", F.coalesce("gnss_n", F.lit(0)).cast("long"))
        place = F.coalesce(geo.normal_gravity(F.radians("__o.lat_deg"), F.col("__o.h_m")), place)
    else:
        out = out.withColumn("gnss_n", F.lit(0).cast("long"))
    out = out.withColumn("gravity_dev", F.col("__norm") / place - 1.0).drop("__norm", "__o")
    return out.withColumns({"aiding_mode": F.lit(config.get("aiding", "gnss")), "delay_ms": F.lit(float(config.get("gnss", {}).get("delay_ms", 0.0)))})
