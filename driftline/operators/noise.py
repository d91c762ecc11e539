"""What an Allan curve says of a sensor, and whether it lay still. A curve has recording_id, tau_s and adev."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.operators import quality
from driftline.operators.signal import FLOOR_FACTOR

#: Read-out points in s, least points of a fit, slope tolerance, clusters that a reliable tau needs.
WHITE_TAU, WALK_TAU, FIT_POINTS, SLOPE_TOLERANCE, CLUSTERS = 1.0, 3.0, 3, 0.25, 10
#: Bias instability in degrees an hour below which a gyroscope has a grade.
GRADES = ((0.01, "navigation grade"), (0.1, "high-end tactical grade"), (1.0, "tactical grade"), (10.0, "industrial MEMS"), (float("inf"), "consumer MEMS"))
#: Spread between axes that is suspicious.
AXIS_SPREAD = 3.0


def factors(tau0: float, duration_s: float, n: int = 60) -> list[int]:
    """Averaging factors, evenly spaced by their logarithm up to a quarter of the record, with the two read-out points."""
    top = max(4, int(duration_s / tau0 / 4))
    grid = {round(top ** (i / (n - 1))) for i in range(n)}
    return sorted(grid | {round(t / tau0) for t in (WHITE_TAU, WALK_TAU) if tau0 <= t <= duration_s / 4})


def local_slope(curve: DataFrame) -> DataFrame:
    """curve with slope: the exponent of the power law around each point, of second order between unevenly spaced neighbours and of first order at both ends."""
    w = W.partitionBy("recording_id").orderBy(F.asc_nulls_last("tau_s"))
    x, y = F.log("tau_s"), F.log("adev")
    low, high = x - F.lag(x).over(w), F.lead(x).over(w) - x
    fall, rise = (y - F.lag(y).over(w)) / low, (F.lead(y).over(w) - y) / high
    return curve.withColumn("slope", F.coalesce((low * rise + high * fall) / (low + high), rise, fall))


def axis_analysis(curve: DataFrame, durations: DataFrame) -> DataFrame:
    """White noise at 1 s, random walk at 3 s, whether that is a fit (or the bound that the curve sets), and where the rise begins.

    durations: recording_id, duration_s; each of its rows has a result, all null where the curve has fewer than three points over 0.
    """
    good = curve.where("adev > 0 AND adev < double('inf')").select("recording_id", "tau_s", "adev")
    all_ = W.partitionBy("recording_id")
    p = local_slope(good).join(durations, "recording_id").withColumn("sure", F.col("tau_s") <= F.col("duration_s") / CLUSTERS)
    p = p.withColumn("sure", F.col("sure") | ~F.max("sure").over(all_)).withColumn("points", F.count(F.lit(1)).over(all_))
    p = p.withColumn("floor", F.min(F.when(F.col("sure"), F.struct("adev", "tau_s"))).over(all_)["tau_s"])
    left, right = F.col("tau_s") <= F.col("floor"), F.col("tau_s") >= F.col("floor")
    white, walk = left & (F.abs(F.col("slope") + 0.5) <= SLOPE_TOLERANCE), F.col("sure") & right & (F.abs(F.col("slope") - 0.5) <= SLOPE_TOLERANCE)

    def read(mask: Column, exponent: float, tau_ref: float) -> tuple[Column, Column]:
        """The fitted coefficient (null below three points) and the highest that stays under the curve, over the masked points."""
        at = F.when(mask, F.col("adev") / F.pow(F.col("tau_s") / tau_ref, exponent))
        return F.when(F.count(at) >= FIT_POINTS, F.exp(F.avg(F.log(at)))), F.min(at)

    g = p.where(F.col("points") >= FIT_POINTS).groupBy("recording_id").agg(
        F.coalesce(read(white, -0.5, WHITE_TAU)[0], read(left, -0.5, WHITE_TAU)[1]).alias("white_noise"),
        F.coalesce(read(walk, 0.5, WALK_TAU)[0], read(F.col("sure"), 0.5, WALK_TAU)[1]).alias("random_walk"),
        read(walk, 0.5, WALK_TAU)[0].isNotNull().alias("resolved"),
        F.min(F.when(right & (F.col("slope") >= 0.5 - SLOPE_TOLERANCE), F.col("tau_s"))).alias("rise_s"),
    )
    return durations.select("recording_id").join(g, "recording_id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def bias_floor(curve: DataFrame, tau_max: Column) -> DataFrame:
    """Bias instability and its tau up to tau_max; not resolved where the least value is at the last of them."""
    ok = curve.where((F.col("tau_s") <= tau_max) & F.expr("adev > 0 AND adev < double('inf')"))
    low = F.min(F.struct("adev", "tau_s"))
    return ok.groupBy("recording_id").agg((low["adev"] / FLOOR_FACTOR).alias("bias_instability"), low["tau_s"].alias("tau_s"), (low["tau_s"] != F.max("tau_s")).alias("resolved"))


def grade(worst_rad_s: Column) -> Column:
    """What the worst axis's bias instability makes of a gyroscope; null without one."""
    dph = F.degrees(worst_rad_s) * 3600
    out = F.lit(None).cast("string")
    for edge, name in reversed(GRADES):
        out = F.when(dph < edge, name).otherwise(out)
    return out


def implausible(value: Column, low: float, high: float) -> Column:
    return F.coalesce((value < low) | (value > high), F.lit(False))


def axes_disagree(values: list[Column], most: float = AXIS_SPREAD) -> Column:
    """Whether the largest of all axes' values is over `most` times the least; values are over 0 and none is missing."""
    return F.coalesce(F.least(*values) > 0, F.lit(False)) & F.coalesce(F.greatest(*values) / F.least(*values) > most, F.lit(False)) & ~F.greatest(*(v.isNull() for v in values))


def full_windows(df: DataFrame, rows: int) -> DataFrame:
    """df with window, over windows of `rows` each; a tail that is not full goes, and recordings of fewer than two windows."""
    of = W.partitionBy("recording_id")
    r = df.withColumn("window", F.floor((F.row_number().over(of.orderBy("t_us", "seq")) - 1) / rows).cast("long")).withColumn("windows", F.floor(F.count(F.lit(1)).over(of) / rows))
    return r.where("windows >= 2 AND window < windows").drop("windows")


def window_peaks(df: DataFrame, rows: int, axes: list[str]) -> DataFrame:
    """The largest distance, in each window, from the recording's own medians by axis (not from zero: a sensor at rest has a bias)."""
    w = full_windows(df, rows)
    long = w.select("recording_id", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("x")) for a in axes))).alias("v")).select("recording_id", "v.*")
    m = quality.order_statistics(long, ["recording_id", "axis"], "x").groupBy("recording_id").agg(*(F.max(F.when(F.col("axis") == a, F.col("median"))).alias(f"rest_{a}") for a in axes))
    off = F.sqrt(sum(((F.col(a) - F.col(f"rest_{a}")) ** 2 for a in axes[1:]), (F.col(axes[0]) - F.col(f"rest_{axes[0]}")) ** 2))
    return w.join(m, "recording_id").groupBy("recording_id", "window").agg(F.max(off).alias("peak"))


def window_means(df: DataFrame, rows: int, axes: list[str]) -> DataFrame:
    """Means by axis over windows of `rows` each: what is left of the white noise is the wander of the bias."""
    return full_windows(df, rows).groupBy("recording_id", "window").agg(*(F.avg(a).alias(a) for a in axes))


def trace_window_s(duration_s: Column) -> Column:
    """The window for `window_means`: 30 s or a 400th of the recording, yet no more than a 20th of it (1 s at least)."""
    return F.least(F.greatest(F.lit(30.0), duration_s / 400), F.greatest(F.lit(1.0), duration_s / 20))


def motion_segments(peaks: DataFrame, least: float) -> DataFrame:
    """Runs of windows whose peak is over `least`: first and last window, and the highest peak."""
    f = peaks.where(F.col("peak") > least)
    run = F.col("window") - F.row_number().over(W.partitionBy("recording_id").orderBy("window"))
    return f.withColumn("run", run).groupBy("recording_id", "run").agg(F.min("window").alias("first"), F.max("window").alias("last"), F.max("peak").alias("peak")).drop("run")


def standstill_accuracy(df: DataFrame, by: list[str], phase: list[str], groups: dict[str, tuple[list[str], str | None]], least: int = 4) -> DataFrame:
    """Spread of values while a platform stands, against the sigma that was reported for them.

    groups: name -> (axes, column of the reported sigma or null). Each phase's mean by axis is taken off; the axes of a
    group and all phases of at least `least` rows are pooled. For each group: measured, reported (root mean square) and their ratio.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for name, (axes, sigma) in groups.items():
        aggs += [F.count(a).alias(f"n_{a}") for a in axes] + [F.var_pop(a).alias(f"v_{a}") for a in axes]
        if sigma:
            aggs += [F.sum(F.col(sigma) * F.col(sigma)).alias(f"q_{name}"), F.count(sigma).alias(f"c_{name}")]
    p = df.groupBy(*by, *phase).agg(*aggs).where(F.col("rows") >= least)
    out = [F.count(F.lit(1)).alias("phases"), F.sum("rows").alias("rows")]
    for name, (axes, sigma) in groups.items():
        squares = F.sum(sum((F.when(F.col(f"n_{a}") > 1, F.col(f"v_{a}") * F.col(f"n_{a}")).otherwise(0.0) for a in axes), F.lit(0.0)))
        dof = F.sum(sum((F.greatest(F.col(f"n_{a}") - 1, F.lit(0)) for a in axes), F.lit(0)))
        out.append(F.when(dof > 0, F.sqrt(squares / dof)).alias(f"{name}_measured"))
        out.append((F.when(F.sum(f"c_{name}") > 0, F.sqrt(F.sum(f"q_{name}") / F.sum(f"c_{name}"))) if sigma else F.lit(None).cast("double")).alias(f"{name}_reported"))
    g = p.groupBy(*by).agg(*out)
    return g.withColumns({f"{n}_ratio": F.when(F.col(f"{n}_reported") > 0, F.col(f"{n}_measured") / F.col(f"{n}_reported")) for n in groups})
