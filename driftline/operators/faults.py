"""Faults for fixes, by a seed: keyed tables of modifications that are merged and applied."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions.geo import dned_to_dllh
from driftline.operators.filters import per_recording

#: Kinds of faults; speed of a platform that stands; seconds from its first motion to the first event, from event
#: to event, between steps and before the truth's end; when spikes come within an event; least and greatest sizes in m and m/s;
#: least and greatest lengths in s; sigmas that are reported, horizontal and vertical; size and window of gross errors.
KINDS = ("spike", "wrong_fix", "multipath", "degraded", "vel_spike", "step", "big_step", "gross")
STILL_MPS, AFTER_S, PERIOD_S, STEP_PERIOD_S, TAIL_S = 0.3, 120.0, 90.0, 300.0, 90.0
SPIKE_AT_S, SPIKE_M, WRONG_M, MULTIPATH_M, STEP_M, BIG_STEP_M, VEL_SPIKE_MPS = (0.0, 3.0, 6.0), (5.0, 50.0), (0.5, 3.0), (3.0, 15.0), (0.5, 2.0), (5.0, 10.0), (1.0, 5.0)
LENGTH_S, DEGRADED_S, STEP_S, REPORTED_M, GROSS_M, GROSS_S, GROSS_N = (5.0, 30.0), 30.0, 150.0, (1.0, 2.0), 500.0, 30.0, 3
#: Sigmas and correlation time of a single point solution.
POINT_M, POINT_TAU_S = (1.5, 3.0), 30.0
#: Columns of a modification: offsets, reported sigmas (null: as they were), velocity errors (null: none), and kind and event.
MODS = "dn double, de double, dd double, sd_h double, sd_v double, dvn double, dve double, dvd double"


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) for each key: the same on every run and for any partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(2**53))


def normal(seed: int, *keys: str) -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(seed, *keys))) * F.cos(2 * 3.141592653589793 * uniform(seed + 1, *keys))


def jumps(fixes: DataFrame, start_s: float, every_s: float, length_s: float, size_m: float, seed: int = 1) -> DataFrame:
    """recording_id, t_us, dn, de, dd: constant offsets in random directions over windows that repeat."""
    k = F.floor((F.col("s") - start_s) / every_s).cast("long")
    w = fixes.withColumn("s", F.col("t_us") / 1e6).withColumn("k", k).where((F.col("s") >= start_s) & (F.col("s") - start_s - F.col("k") * every_s < length_s))
    angle = 2 * 3.141592653589793 * uniform(seed, "recording_id", "k")
    return w.select("recording_id", "t_us", (size_m * F.cos(angle)).alias("dn"), (size_m * F.sin(angle)).alias("de"), F.lit(0.0).alias("dd"))


def drift(fixes: DataFrame, start_s: float, rate_mps: float) -> DataFrame:
    """A ramp to the east from a time on."""
    s = fixes.withColumn("s", F.col("t_us") / 1e6 - start_s).where("s >= 0")
    return s.select("recording_id", "t_us", F.lit(0.0).alias("dn"), (F.col("s") * rate_mps).alias("de"), F.lit(0.0).alias("dd"))


def merged(*mods: DataFrame) -> DataFrame:
    """Offsets of several tables added up by fix."""
    out = mods[0]
    for m in mods[1:]:
        out = out.unionByName(m)
    return out.groupBy("recording_id", "t_us").agg(*(F.sum(c).alias(c) for c in ("dn", "de", "dd")))


def applied(fixes: DataFrame, mods: DataFrame, cov_scale: float = 1.0) -> DataFrame:
    """Fixes with their positions moved; variances of moved fixes are scaled."""
    j = fixes.join(mods, ["recording_id", "t_us"], "left")
    off = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("dn", "de", "dd")}
    lat, lon, h = dned_to_dllh(off["dn"], off["de"], off["dd"], F.radians("lat_deg"), F.col("h_m"))
    out = j.withColumns({"lat_deg": F.col("lat_deg") + F.degrees(lat), "lon_deg": F.col("lon_deg") + F.degrees(lon), "h_m": F.col("h_m") + h})
    if cov_scale != 1.0:
        out = out.withColumns({c: F.when(F.col("dn").isNotNull(), F.col(c) * cov_scale).otherwise(F.col(c)) for c in fixes.columns if c.startswith("p_")})
    return out.drop("dn", "de", "dd")


# ---- kinds of faults by the fixed values above


def motion_start(truth: DataFrame) -> DataFrame:
    """recording_id, from_us (the first epoch in motion, else the first one), t0_us, t1_us of the truth."""
    moving = F.sqrt(F.col("vn") ** 2 + F.col("ve") ** 2) > STILL_MPS
    return truth.groupBy("recording_id").agg(F.coalesce(F.min(F.when(moving, F.col("t_us"))), F.min("t_us")).alias("from_us"), F.min("t_us").alias("t0_us"), F.max("t_us").alias("t1_us"))


def _between(seed: int, lo: float, hi: float, *keys: str) -> Column:
    return lo + (hi - lo) * uniform(seed, *keys)


def _offset(seed: int, lo: float, hi: float, *keys: str) -> list[Column]:
    """A horizontal vector of random size and direction, and a vertical part of up to the same size."""
    size, way = _between(seed, lo, hi, *keys), 2 * np.pi * uniform(seed + 1, *keys)
    return [size * F.cos(way), size * F.sin(way), size * (2 * uniform(seed + 2, *keys) - 1)]


def fault_mods(fixes: DataFrame, truth: DataFrame, kind: str, seed: int = 1) -> DataFrame:
    """recording_id, t_us, kind, event and MODS of the fixes that a kind of fault changes.

    Events follow from the first motion on at fixed distances, and everything random about one is a hash of seed, recording and
    event: the same for any partitioning, and for a part of the recordings. fixes: recording_id, t_us, seq; those outside the
    truth's time are left alone. truth: recording_id, t_us, vn, ve.
    """
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    seed = seed * 1000 + KINDS.index(kind) * 100
    period = STEP_PERIOD_S if kind in ("step", "big_step") else PERIOD_S
    own = fixes.select("recording_id", "t_us", "seq").join(motion_start(truth), "recording_id").where(F.col("t_us").between(F.col("t0_us"), F.col("t1_us")))
    w = W.partitionBy("recording_id").orderBy("t_us", "seq")
    # Seconds from the first event on, and the same of the fix before.
    s = (F.col("t_us") - F.col("from_us")) / 1e6 - AFTER_S
    own = own.withColumns({"s": s, "before": F.lag(s).over(w), "end": (F.col("t1_us") - F.col("from_us")) / 1e6 - AFTER_S - TAIL_S})
    hit = F.floor(F.col("s") / period).cast("long")
    if kind in ("spike", "vel_spike", "gross"):
        # A fix is hit if it is the first at or after a time of an event: of its own or, where fixes are far apart, one before.
        times = [F.lit(t) for t in SPIKE_AT_S] if kind != "gross" else [_between(seed + 10 + k, 0.0, GROSS_S, "recording_id", "event") for k in range(GROSS_N)]
        own = own.where("s >= 0").withColumn("event", F.explode(F.sequence(F.greatest(F.coalesce(F.floor((F.col("before") - max(SPIKE_AT_S[-1], GROSS_S)) / period), F.lit(0)), F.lit(0)).cast("long"), hit)))
        first = [(F.col("event") * period + t).alias("x") for t in times]
        on = F.lit(False)
        for x in first:
            on = on | ((x <= F.col("s")) & F.coalesce(F.col("before") < x, F.lit(True)))
        keys = ("recording_id", "event", "t_us")
    else:
        own = own.where("s >= 0").withColumn("event", hit)
        length = {"step": F.lit(STEP_S), "big_step": F.lit(STEP_S), "degraded": F.lit(DEGRADED_S)}.get(kind, _between(seed + 10, *LENGTH_S, "recording_id", "event"))
        on, keys = F.col("s") - F.col("event") * period < length, ("recording_id", "event")
    rows = own.where((F.col("event") * period < F.col("end")) & on)
    none = F.lit(None).cast("double")
    sizes = {"spike": SPIKE_M, "wrong_fix": WRONG_M, "multipath": MULTIPATH_M, "step": STEP_M, "big_step": BIG_STEP_M, "gross": (GROSS_M, GROSS_M), "vel_spike": VEL_SPIKE_MPS}
    if kind == "degraded":
        off = [normal(seed + 20 + 2 * k, "recording_id", "t_us") * REPORTED_M[k == 2] for k in range(3)]
    else:
        off = _offset(seed + 20, *sizes[kind], *keys)
    reported = [F.lit(x) for x in REPORTED_M] if kind in ("multipath", "degraded") else [none, none]
    position, velocity = ([F.lit(0.0)] * 3, off) if kind == "vel_spike" else (off, [none] * 3)
    names = [c.split()[0] for c in MODS.split(", ")]
    # A fix that two events hit keeps the later one.
    found = rows.select("recording_id", "t_us", F.lit(kind).alias("kind"), F.col("event").cast("long").alias("event"), *(c.alias(n) for c, n in zip([*position, *reported, *velocity], names, strict=True)))
    last = W.partitionBy("recording_id", "t_us").orderBy(F.desc("event"))
    return found.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")


def fault_events(mods: DataFrame) -> DataFrame:
    """recording_id, kind, event, t0_us, t1_us, fixes of each event, and for steps the offset that is right meanwhile."""
    step = F.col("kind").isin("step", "big_step")
    return mods.groupBy("recording_id", "kind", "event").agg(F.min("t_us").alias("t0_us"), F.max("t_us").alias("t1_us"), F.count(F.lit(1)).alias("fixes"), *(F.first(F.when(step, F.col(c))).alias(f"shift_{c}") for c in ("dn", "de", "dd")))


def point_mods(fixes: DataFrame, seed: int = 2) -> DataFrame:
    """recording_id, t_us, kind, event and MODS for all fixes: errors of a single point solution, correlated in time, of each recording."""
    keyed = fixes.select("recording_id", "t_us").distinct().withColumns({f"z{k}": normal(seed * 1000 + 2 * k, "recording_id", "t_us") for k in range(3)}).withColumn("seq", F.lit(0))
    sd = np.array([POINT_M[0], POINT_M[0], POINT_M[1]])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t_us")
        z, t = frame[["z0", "z1", "z2"]].to_numpy() * sd, frame["t_us"].to_numpy()
        keep = np.exp(-np.diff(t) / 1e6 / POINT_TAU_S)
        x = z.copy()
        for i, a in enumerate(keep, 1):
            x[i] = a * x[i - 1] + (1 - a * a) ** 0.5 * z[i]
        return frame[["recording_id", "t_us"]].assign(dn=x[:, 0], de=x[:, 1], dd=x[:, 2])

    out = per_recording(keyed, run, "dn double, de double, dd double", ("t_us",))
    none = F.lit(None).cast("double")
    return out.select("recording_id", "t_us", F.lit("point").alias("kind"), F.lit(0).cast("long").alias("event"), "dn", "de", "dd", F.lit(POINT_M[0]).alias("sd_h"), F.lit(POINT_M[1]).alias("sd_v"), *(none.alias(c) for c in ("dvn", "dve", "dvd")))


def scenario(fixes: DataFrame, truth: DataFrame, kind: str | None, point: bool = False, seed: int = 1) -> DataFrame:
    """The modifications of a scenario: a kind of fault, on top of point errors if asked for, which keep their sigmas."""
    parts = ([point_mods(fixes, seed + 1)] if point else []) + ([fault_mods(fixes, truth, kind, seed)] if kind else [])
    if len(parts) == 1:
        return parts[0]
    both = parts[0].unionByName(parts[1])
    own = F.col("kind") == "point"
    return both.groupBy("recording_id", "t_us").agg(
        F.max_by("kind", ~own).alias("kind"), F.max("event").alias("event"), *(F.sum(c).alias(c) for c in ("dn", "de", "dd")), *(F.max_by(c, own).alias(c) for c in ("sd_h", "sd_v")), *(F.max(F.when(~own, F.col(c))).alias(c) for c in ("dvn", "dve", "dvd"))
    )


#: All scenarios: name, with point errors, kind of fault.
SCENARIOS = (*((k, False, k) for k in KINDS), ("point", True, None), *((f"point_{k}", True, k) for k in ("spike", "multipath", "vel_spike", "step", "gross")))


def modified(fixes: DataFrame, mods: DataFrame) -> DataFrame:
    """Fixes with MODS applied: positions moved, reported covariances replaced, velocities changed."""
    m = mods.select("recording_id", "t_us", *(c.split()[0] for c in MODS.split(", ")))
    j = fixes.join(m, ["recording_id", "t_us"], "left")
    off = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("dn", "de", "dd", "dvn", "dve", "dvd")}
    lat, lon, h = dned_to_dllh(off["dn"], off["de"], off["dd"], F.radians("lat_deg"), F.col("h_m"))
    out = {"lat_deg": F.col("lat_deg") + F.degrees(lat), "lon_deg": F.col("lon_deg") + F.degrees(lon), "h_m": F.col("h_m") + h} | {v: F.col(v) + off[f"d{v}"] for v in ("vn", "ve", "vd")}
    told = F.col("sd_h").isNotNull()
    new = {"p_nn": F.col("sd_h") ** 2, "p_ee": F.col("sd_h") ** 2, "p_dd": F.col("sd_v") ** 2} | {c: F.lit(0.0) for c in ("p_ne", "p_nd", "p_ed")}
    out |= {c: F.when(told, x).otherwise(F.col(c)) for c, x in new.items()}
    return j.withColumns(out).select(*fixes.columns)
