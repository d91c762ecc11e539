"""Statistics of a stream's quality. A stream has recording_id, t_us, seq and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def by_recording() -> WindowSpec:
    return W.partitionBy("recording_id")


def in_time() -> WindowSpec:
    return by_recording().orderBy("t_us", "seq")


def gap_statistics(df: DataFrame) -> DataFrame:
    """n, duration_s, avg_hz ((n - 1) / span), max_gap_s and where it ends; the first of equal gaps."""
    gap = F.col("t_us") - F.lag("t_us").over(in_time())
    g = df.select("recording_id", "t_us", gap.alias("gap")).groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("t_us").alias("t0"), F.max("t_us").alias("t1"), F.max("gap").alias("gap"), F.max_by("t_us", F.struct("gap", -F.col("t_us"))).alias("at"))
    span = (F.col("t1") - F.col("t0")) / 1e6
    some = F.coalesce(F.col("gap") > 0, F.lit(False))
    return g.select("recording_id", "n", span.alias("duration_s"), F.when(span > 0, (F.col("n") - 1) / span).otherwise(0.0).alias("avg_hz"), F.when(some, F.col("gap") / 1e6).otherwise(0.0).alias("max_gap_s"), F.when(some, (F.col("at") - F.col("t0")) / 1e6).otherwise(0.0).alias("max_gap_at_s"))


def bucketed_rate(df: DataFrame, bucket_s: float) -> DataFrame:
    """bucket, n, hz for all buckets from a recording's first sample to its last, empty ones too."""
    start = W.partitionBy("recording_id")
    b = df.withColumn("bucket", ((F.col("t_us") - F.min("t_us").over(start)) / 1e6 / bucket_s).cast("long"))
    counts = b.groupBy("recording_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    spine = counts.groupBy("recording_id").agg(F.max("bucket").alias("last")).select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bucket"))
    return spine.join(counts, ["recording_id", "bucket"], "left").select("recording_id", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) / bucket_s).alias("hz"))


def difference_noise(df: DataFrame, max_gap_us: int) -> DataFrame:
    """Noise floor sqrt(var(d2) / 6), the ratio of third to second differences, and whether that shows a band limit.

    Differences reach only over intervals over 0 and below max_gap_us.
    """
    d = df.select("recording_id", *(F.lag(c, k).over(in_time()).alias(f"{c[0]}{k}") for c in ("value", "t_us") for k in range(4)))
    near = lambda k: (F.col(f"t{k}") - F.col(f"t{k + 1}") > 0) & (F.col(f"t{k}") - F.col(f"t{k + 1}") < max_gap_us)
    d = d.withColumn("d2", F.when(near(0) & near(1), F.col("v0") - 2 * F.col("v1") + F.col("v2")))
    d = d.withColumn("d3", F.when(near(0) & near(1) & near(2), F.col("v0") - 3 * F.col("v1") + 3 * F.col("v2") - F.col("v3")))
    g = d.groupBy("recording_id").agg(F.count("d2").alias("n2"), F.count("d3").alias("n3"), F.var_pop("d2").alias("s2"), F.var_pop("d3").alias("s3"))
    ratio = F.when((F.col("n3") > 1) & (F.col("s2") > 0), F.col("s3") / F.col("s2"))
    return g.select("recording_id", "n2", "n3", F.when(F.col("n2") > 1, F.sqrt(F.col("s2") / 6)).alias("noise"), ratio.alias("ratio"), (ratio < 2.5).alias("band_limited"))


def gaps_and_noise(df: DataFrame, columns: list[str], max_gap_us: int, *also: Column) -> DataFrame:
    """What gap_statistics and difference_noise (noise_<column>, limited_<column>) tell, and aggregates of the rows besides, in one pass in order of time."""
    lags = {f"__{c}{k}": F.lag(c, k).over(in_time()) for c in ("t_us", *columns) for k in range(1, 4 if columns else 2)}
    d = df.select("*", *(x.alias(n) for n, x in lags.items()))
    v = lambda c, k: F.col(f"__{c}{k}" if k else c)
    gap = lambda k: v("t_us", k) - v("t_us", k + 1)
    near = lambda k: (gap(k) > 0) & (gap(k) < max_gap_us)
    each = []
    for c in columns:
        d2 = F.when(near(0) & near(1), v(c, 0) - 2 * v(c, 1) + v(c, 2))
        d3 = F.when(near(0) & near(1) & near(2), v(c, 0) - 3 * v(c, 1) + 3 * v(c, 2) - v(c, 3))
        each += [F.count(d2).alias(f"n2_{c}"), F.count(d3).alias(f"n3_{c}"), F.var_pop(d2).alias(f"s2_{c}"), F.var_pop(d3).alias(f"s3_{c}")]
    longest, at = F.max(gap(0)).alias("gap"), F.max_by("t_us", F.struct(gap(0).alias("gap"), -F.col("t_us"))).alias("at")
    g = d.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("t0"), F.max("t_us").alias("t1"), longest, at, *each, *also)
    span, some = (F.col("t1") - F.col("t0")) / 1e6, F.coalesce(F.col("gap") > 0, F.lit(False))
    told = {"duration_s": span, "avg_hz": F.when(span > 0, (F.col("n") - 1) / span).otherwise(0.0), "max_gap_s": F.when(some, F.col("gap") / 1e6).otherwise(0.0), "max_gap_at_s": F.when(some, (F.col("at") - F.col("t0")) / 1e6).otherwise(0.0)}
    for c in columns:
        told[f"noise_{c}"] = F.when(F.col(f"n2_{c}") > 1, F.sqrt(F.col(f"s2_{c}") / 6))
        told[f"limited_{c}"] = F.when((F.col(f"n3_{c}") > 1) & (F.col(f"s2_{c}") > 0), F.col(f"s3_{c}") / F.col(f"s2_{c}")) < 2.5
    made = ("t0", "t1", "gap", "at", *(f"{k}_{c}" for c in columns for k in ("n2", "n3", "s2", "s3")))
    return g.withColumns(told).drop(*made)


def score_statistics(df: DataFrame, by: list[str], error: str) -> DataFrame:
    """n, mean, population std (0 below two), rms and largest magnitude."""
    e = F.col(error)
    return df.groupBy(*by).agg(
        F.count(e).alias("n"), F.avg(e).alias("mean"), F.when(F.count(e) < 2, 0.0).otherwise(F.stddev_pop(e)).alias("std"), F.sqrt(F.avg(e * e)).alias("rms"), F.max(F.abs(e)).alias("max_abs"))


def ranked(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, x, its rank r (from 0, nulls last) and the group's number n of values: a sort that spills, not a list in memory."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.asc_nulls_last(x))) - 1
    return df.select(*by, F.col(x).alias("x"), rank.alias("r"), F.count(x).over(W.partitionBy(*by)).alias("n"))


def order_statistics(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Upper median, true median, and nearest-rank 5 % and 95 % quantiles."""
    n = F.col("n")
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("x")))
    near = lambda p: (p * (n - 1) + 0.5).cast("int")
    low, high = at(((n - 1) / 2).cast("int")), at((n / 2).cast("int"))
    out = ranked(df, by, x).groupBy(*by).agg(F.max("n").alias("n"), high.alias("upper_median"), ((low + high) / 2).alias("median"), at(near(0.05)).alias("p5"), at(near(0.95)).alias("p95"))
    return out.withColumn("n", F.col("n").cast("long"))


def pooled_std(df: DataFrame, by: list[str], phase: list[str], x: str, least: int) -> DataFrame:
    """Standard deviation within phases of at least `least` rows, pooled: sqrt(sum of squares / sum of (n - 1))."""
    each = df.groupBy(*by, *phase).agg(F.count(x).alias("n"), F.var_samp(x).alias("v")).where(F.col("n") >= max(2, least))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("phases"), F.sqrt(F.sum(F.col("v") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)).alias("pooled_std"))


def shares(df: DataFrame, by: list[str], kind: Column) -> DataFrame:
    """Counts and shares of kinds; null kinds (unknown) are left out."""
    c = df.withColumn("kind", kind).where(F.col("kind").isNotNull()).groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def start_mean(df: DataFrame, window_us: int, least: int = 10) -> DataFrame:
    """Mean over each recording's first window; null below `least` rows."""
    first = F.min("t_us").over(W.partitionBy("recording_id"))
    g = df.withColumn("t0", first).where(F.col("t_us") - F.col("t0") <= window_us).groupBy("recording_id")
    return g.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, F.avg("value")).alias("bias"))


def integrity(df: DataFrame, by: list[str], satellites: str) -> DataFrame:
    """Upper median and least number of satellites."""
    r = ranked(df.where(F.col(satellites) > 0), by, satellites)
    return r.groupBy(*by).agg(F.max(F.when(F.col("r") == (F.col("n") / 2).cast("int"), F.col("x"))).alias("sat_median"), F.min("x").alias("sat_min"))


def latency(fixes: DataFrame, offset_s: Column, rate: Column) -> DataFrame:
    """fixes with latency_ms: t_us less the clock's time of the fix's own GPS time; null without a week.

    fixes: t_us, gps_week, gps_tow_s. GPS seconds are offset_s + rate * t_us.
    """
    gps = F.col("gps_week") * 604800 + F.col("gps_tow_s")
    return fixes.withColumn("latency_ms", F.when(F.col("gps_week") != 0, (F.col("t_us") - (gps - offset_s) / rate) / 1e3))


def gravity_check(still: DataFrame, by: list[str], norm: str, gravity: Column, least: int) -> DataFrame:
    """n, the true median of the specific force at rest, gravity, and their relative deviation, where there are `least` rows."""
    m = order_statistics(still, by, norm).where(F.col("n") >= least).select(*by, "n", "median")
    return m.withColumn("g", gravity).withColumn("dev", F.col("median") / F.col("g") - 1.0)
