"""From the streams of a dataset to a track and its scores.

The inertial samples drive: each takes, of every other stream, the newest row that
came since the sample before, and with it the age that the row has by then. Rows
that a newer one overtook are lost, rows after the last sample are never used. It
is one union of all streams and one shuffle by recording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions import geo
from driftline.operators import scoring, suite

IMU = ("gyr_x", "gyr_y", "gyr_z", "acc_x", "acc_y", "acc_z")
#: What a sample takes from each stream.
TAKEN = {
    "gnss": ("lat_deg", "lon_deg", "h_m", "p_nn", "p_ee", "p_dd", "vn", "ve", "vd", "v_nn", "v_ee", "v_dd", "vel_ok"), "mag": ("mag_x", "mag_y", "mag_z"), "baro": ("pressure_pa",),
    "speed": ("speed_mps",), "heading": ("heading_deg", "stddev_deg"),
}


def origins(fixes: DataFrame) -> DataFrame:
    """recording_id, lat0, lon0 (radians), h0 of the first fix."""
    return fixes.groupBy("recording_id").agg(F.min_by(F.struct("lat_deg", "lon_deg", "h_m"), F.struct("t_us", "seq")).alias("o")).select("recording_id", F.radians("o.lat_deg").alias("lat0"), F.radians("o.lon_deg").alias("lon0"), F.col("o.h_m").alias("h0"))


def joined(streams: dict[str, DataFrame]) -> DataFrame:
    """The inertial samples with a struct of TAKEN, t_us and age_us for each other stream, null where no new row has come.

    age_us: of the row at the sample, its own (a column age_us, if it has one) included.
    """
    names = [s for s in TAKEN if s in streams]
    kind = {s: "struct<t_us:bigint,seq:bigint,age_us:bigint," + ",".join(f"{c}:double" for c in TAKEN[s]) + ">" for s in names}
    imu = "struct<t_us:bigint,seq:bigint," + ",".join(f"{c}:double" for c in IMU) + ">"
    none = lambda own: [F.lit(None).cast(kind[s]).alias(s) for s in names if s != own]
    u = streams["imu"].select("recording_id", "t_us", "seq", F.struct("t_us", "seq", *IMU).cast(imu).alias("imu"), *none(None), F.lit(1).alias("side"))
    for s in names:
        age = F.col("age_us") if "age_us" in streams[s].columns else F.lit(0)
        own = F.struct("t_us", "seq", age.cast("long").alias("age_us"), *(F.col(c).cast("double").alias(c) for c in TAKEN[s])).cast(kind[s]).alias(s)
        u = u.unionByName(streams[s].select("recording_id", "t_us", "seq", F.lit(None).cast(imu).alias("imu"), own, *none(s), F.lit(0).alias("side")))
    from_end = W.partitionBy("recording_id").orderBy(F.desc("t_us"), F.desc("side"), F.desc("seq")).rowsBetween(W.unboundedPreceding, 0)
    met = u.withColumn("e", F.last("imu", ignorenulls=True).over(from_end)).where(F.col("e").isNotNull())
    newest = [F.max_by(s, F.struct(f"{s}.t_us", f"{s}.seq")).alias(s) for s in names]
    out = met.groupBy("recording_id", F.col("e.t_us").alias("t_us"), F.col("e.seq").alias("seq")).agg(F.first("imu", ignorenulls=True).alias("imu"), *newest)
    aged = {s: F.when(F.col(s).isNotNull(), F.col(s).withField("age_us", F.col(s)["age_us"] + F.col("t_us") - F.col(s)["t_us"])) for s in names}
    return out.select("recording_id", "t_us", "seq", *(F.col(f"imu.{c}").alias(c) for c in IMU), *(c.alias(s) for s, c in aged.items()))


def aligned(streams: dict[str, DataFrame], speed_sigma: float = 0.1) -> DataFrame:
    """Rows as the filters take them, fixes in the frame of each recording's first fix."""
    rows = joined(streams)
    out = {}
    if "gnss" in streams:
        rows = rows.join(origins(streams["gnss"]), "recording_id", "left")
        local = geo.to_local((F.radians("gnss.lat_deg"), F.radians("gnss.lon_deg"), F.col("gnss.h_m")), (F.col("lat0"), F.col("lon0"), F.col("h0")))
        out |= {f"fix_{a}": c for a, c in zip("ned", local, strict=True)} | {f"fix_var_{a}": F.col(f"gnss.p_{a}{a}") for a in "ned"}
        out |= {f"vel_{a}": F.when(F.col("gnss.vel_ok") > 0, F.col(f"gnss.v{a}")) for a in "ned"} | {f"vel_var_{a}": F.when(F.col("gnss.vel_ok") > 0, F.col(f"gnss.v_{a}{a}")) for a in "ned"}
        out["fix_age_s"] = F.col("gnss.age_us") / 1e6
    if "mag" in streams:
        out |= {c: F.col(f"mag.{c}") for c in TAKEN["mag"]}
    if "baro" in streams:
        out["pressure"] = F.col("baro.pressure_pa")
    if "speed" in streams:
        out |= {"speed": F.col("speed.speed_mps"), "speed_var": F.when(F.col("speed").isNotNull(), speed_sigma**2), "speed_age_s": F.col("speed.age_us") / 1e6}
    if "heading" in streams:
        out |= {"yaw": F.radians("heading.heading_deg"), "yaw_var": F.pow(F.radians("heading.stddev_deg"), 2), "yaw_age_s": F.col("heading.age_us") / 1e6}
    return rows.select("recording_id", "t_us", "seq", *IMU, *(c.alias(n) for n, c in out.items()))


def local_truth(truth: DataFrame, fixes: DataFrame) -> DataFrame:
    """Truth rows with scoring's columns in the frame of each recording's first fix."""
    own = truth.join(origins(fixes), "recording_id")
    local = geo.to_local((F.radians("lat_deg"), F.radians("lon_deg"), F.col("h_m")), (F.col("lat0"), F.col("lon0"), F.col("h0")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return own.select("recording_id", "t_us", "seq", *(c.alias(a) for a, c in zip("ned", local, strict=True)), zero("vn"), zero("ve"), zero("vd"), *(F.radians(f"{a}_deg").alias(a) for a in scoring.ANGLES))


def replayed(streams: dict[str, DataFrame], config: dict, gate: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """The suite's track, and recording_id, metric, value of its scores against the truth (where the streams have one: ref).

    config: as sources.recordings.settings returns it.
    """
    track = suite.suite_track(aligned(streams, float(config["speed"]["stddev_mps"])), gate, arm=tuple(config["gnss"]["leverarm_frd"]))
    if "ref" not in streams:
        return track, track.sparkSession.createDataFrame([], f"recording_id {track.schema['recording_id'].dataType.simpleString()}, metric string, value double")
    found = scoring.errors(track.where(F.col("n").isNotNull() & ~F.isnan("n")), local_truth(streams["ref"], streams["gnss"]))
    return track, scoring.score(found, float(config["score"]["warmup_sec"]))
