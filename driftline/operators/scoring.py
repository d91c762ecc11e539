"""A track against truth: errors at the truth's epochs, statistics by axis, and limits that a run has to keep."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POSITION, VELOCITY, ANGLES = ("n", "e", "d"), ("vn", "ve", "vd"), ("roll", "pitch", "yaw")


def wrapped(x: Column) -> Column:
    return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi


def errors(track: DataFrame, truth: DataFrame, span_us: int = 1_000_000, delay_us: int = 0) -> DataFrame:
    """recording_id, t_us, seq of each truth row, age_us, and the track's error in POSITION, VELOCITY and ANGLES there.

    Both sides have recording_id, t_us, seq and these columns (ANGLES in radians); delay_us moves the truth to earlier times
    first. A truth row meets the first track row at or after it, age_us later: the position is moved back by the velocity,
    angles are interpolated with the row before, over the shorter arc, where both lie within span_us. Truth rows after the
    track's end have no error and are left out.
    """
    columns = (*POSITION, *VELOCITY, *ANGLES)
    packed = F.struct("t_us", *columns)
    kind = "struct<t_us:bigint," + ",".join(f"{c}:double" for c in columns) + ">"
    none = F.lit(None).cast(kind)
    one = track.select("recording_id", "t_us", "seq", packed.cast(kind).alias("a"), none.alias("b"), F.lit(1).alias("side"))
    two = truth.withColumn("t_us", F.col("t_us") - delay_us).select("recording_id", "t_us", "seq", none.alias("a"), packed.cast(kind).alias("b"), F.lit(0).alias("side"))
    by_time = W.partitionBy("recording_id").orderBy("t_us", "side", "seq").rowsBetween(W.unboundedPreceding, 0)
    from_end = W.partitionBy("recording_id").orderBy(F.desc("t_us"), F.desc("side"), F.desc("seq")).rowsBetween(W.unboundedPreceding, 0)
    u = one.unionByName(two).withColumns({"p": F.last("a", ignorenulls=True).over(by_time), "x": F.last("a", ignorenulls=True).over(from_end)})
    u = u.where(F.col("b").isNotNull() & F.col("x").isNotNull())
    age = F.col("x.t_us") - F.col("t_us")
    gap = F.col("x.t_us") - F.col("p.t_us")
    back = F.when((gap > 0) & (gap <= span_us), age / gap).otherwise(0.0)
    out = {c: F.col(f"x.{c}") - F.col(f"x.{v}") * age / 1e6 - F.col(f"b.{c}") for c, v in zip(POSITION, VELOCITY, strict=True)}
    out |= {c: F.col(f"x.{c}") - F.col(f"b.{c}") for c in VELOCITY}
    out |= {c: wrapped(F.col(f"x.{c}") + back * F.coalesce(wrapped(F.col(f"p.{c}") - F.col(f"x.{c}")), F.lit(0.0)) - F.col(f"b.{c}")) for c in ANGLES}
    return u.select("recording_id", "t_us", "seq", age.alias("age_us"), *(c.alias(n) for n, c in out.items()))


def score(errors: DataFrame, warmup_s: float = 0.0, from_s: float | None = None, to_s: float | None = None) -> DataFrame:
    """recording_id, metric, value: bias, deviation, rms and greatest errors, in m, m/s and degrees; yaw_drift_deg_min by a straight line.

    warmup_s: seconds from a recording's first error that do not count; from_s, to_s: of what is left, seconds from the same start.
    """
    t = (F.col("t_us") - F.min("t_us").over(W.partitionBy("recording_id"))) / 1e6
    e = errors.withColumn("s", t).where(F.col("s") >= warmup_s)
    e = e.where(F.col("s") >= from_s) if from_s is not None else e
    e = e.where(F.col("s") < to_s) if to_s is not None else e
    flat, whole = F.sqrt(F.col("n") ** 2 + F.col("e") ** 2), F.sqrt(F.col("n") ** 2 + F.col("e") ** 2 + F.col("d") ** 2)
    speed = F.sqrt(sum((F.col(c) ** 2 for c in VELOCITY), F.lit(0.0)))
    std = lambda c: F.when(F.count(c) < 2, 0.0).otherwise(F.stddev_pop(c))
    deg = {c: F.degrees(c) for c in ANGLES}
    metrics = {
        "epochs": F.count(F.lit(1)).cast("double"), "pos_rms_m": F.sqrt(F.avg(whole**2)), "pos_hor_rms_m": F.sqrt(F.avg(flat**2)), "pos_max_m": F.max(whole), "height_bias_m": F.avg(-F.col("d")), "height_rms_m": F.sqrt(F.avg(F.col("d") ** 2)), "vel_rms_mps": F.sqrt(F.avg(speed**2)),
        "att_bias_deg": F.greatest(F.abs(F.avg(deg["roll"])), F.abs(F.avg(deg["pitch"]))), "att_std_deg": F.greatest(std(deg["roll"]), std(deg["pitch"])), "yaw_bias_deg": F.abs(F.avg(deg["yaw"])), "yaw_std_deg": std(deg["yaw"]),
        "yaw_drift_deg_min": F.regr_slope(deg["yaw"], F.col("s") / 60.0),
    }
    each = e.groupBy("recording_id").agg(*(c.alias(n) for n, c in metrics.items()))
    return each.select("recording_id", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics))).alias("m")).select("recording_id", "m.metric", "m.value")


def judged(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """recording_id, metric, value, limit, passed: a row for each limit (recording_id, metric, limit); a metric that is not there does not pass."""
    return limits.join(scores, ["recording_id", "metric"], "left").select("recording_id", "metric", "value", "limit", F.coalesce(F.abs("value") <= F.col("limit"), F.lit(False)).alias("passed"))


def coasting(errors: DataFrame, aiding: DataFrame, least_s: float, warmup_s: float = 0.0) -> DataFrame:
    """recording_id, t0_us, t1_us, horizontal_m, vertical_m: the last error before aiding comes back, for each gap of least_s or more.

    aiding: recording_id, t_us of the epochs with aiding; the first warmup_s of a recording do not count. Errors are less what was there at the gap's start.
    """
    w = W.partitionBy("recording_id").orderBy("t_us")
    gaps = aiding.select("recording_id", "t_us").distinct().withColumns({"t0_us": F.col("t_us"), "t1_us": F.lead("t_us").over(w), "from": F.min("t_us").over(W.partitionBy("recording_id"))})
    gaps = gaps.where((F.col("t1_us") - F.col("t0_us") >= least_s * 1e6) & (F.col("t0_us") - F.col("from") >= warmup_s * 1e6))
    both = gaps.select("recording_id", "t_us", "t0_us", "t1_us", *(F.lit(None).cast("double").alias(c) for c in POSITION), F.lit(0).alias("side")).unionByName(errors.select("recording_id", "t_us", F.lit(None).cast("long").alias("t0_us"), F.lit(None).cast("long").alias("t1_us"), *POSITION, F.lit(1).alias("side")))
    running = W.partitionBy("recording_id").orderBy("t_us", "side").rowsBetween(W.unboundedPreceding, 0)
    held = both.withColumn("g", F.last(F.when(F.col("side") == 0, F.struct("t0_us", "t1_us")), ignorenulls=True).over(running)).where((F.col("side") == 1) & (F.col("t_us") <= F.col("g.t1_us")))
    ends = held.groupBy("recording_id", F.col("g.t0_us").alias("t0_us"), F.col("g.t1_us").alias("t1_us")).agg(*(f(c, "t_us").alias(f"{k}_{c}") for c in POSITION for k, f in (("first", F.min_by), ("last", F.max_by))))
    off = {c: F.col(f"last_{c}") - F.col(f"first_{c}") for c in POSITION}
    return ends.select("recording_id", "t0_us", "t1_us", F.sqrt(off["n"] ** 2 + off["e"] ** 2).alias("horizontal_m"), F.abs(off["d"]).alias("vertical_m"))
