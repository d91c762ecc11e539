"""Runs, sessions and thinning of a stream. A stream has recording_id, t_us, seq and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def by_recording() -> WindowSpec:
    return W.partitionBy("recording_id")


def in_time() -> WindowSpec:
    return by_recording().orderBy("t_us", "seq")


def in_file() -> WindowSpec:
    return by_recording().orderBy("seq")


def sessions(df: DataFrame, factor: float = 5.0) -> DataFrame:
    """df with session, which rises where an interval is over factor times the recording's upper median interval."""
    gap = df.withColumn("gap", F.col("t_us") - F.lag("t_us").over(in_time()))
    rank = F.row_number().over(by_recording().orderBy(F.asc_nulls_last("gap"))) - 1
    ranked = gap.select("recording_id", "gap", rank.alias("r"), F.floor(F.count("gap").over(by_recording()) / 2).alias("k"))
    median = ranked.where("r = k").select("recording_id", F.col("gap").alias("typical"))
    new = F.coalesce(F.col("gap") > factor * F.col("typical"), F.lit(False)).cast("int")
    out = gap.join(median, "recording_id", "left").withColumn("new", new)
    return out.withColumn("session", F.sum("new").over(in_time()).cast("long")).drop("new", "typical", "gap")


def block_means(df: DataFrame, factor: int, by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Means of `factor` rows each, at the last row's time; a tail that is not full goes."""
    row = F.row_number().over(W.partitionBy(*by).orderBy("t_us", "seq")) - 1
    b = df.withColumn("block", F.floor(row / factor).cast("long")).groupBy(*by, "block")
    return b.agg(F.count(F.lit(1)).alias("rows"), F.max("t_us").alias("t_us"), F.avg("value").alias("value")).where(F.col("rows") == factor).drop("rows")


def rolling_variance(df: DataFrame, rows: int) -> DataFrame:
    """df with variance, unbiased, over a centred window of `rows` (made odd, 11 at least); null near the ends, and throughout where the recording is no longer than the window."""
    half = max(11, rows | 1) // 2
    w = in_time().rowsBetween(-half, half)
    longer = F.count(F.lit(1)).over(by_recording()) > 2 * half + 1
    return df.withColumn("variance", F.when(longer & (F.count("value").over(w) == 2 * half + 1), F.greatest(F.var_samp("value").over(w), F.lit(0.0))))


def islands(df: DataFrame, on: Column, least_rows: int = 1) -> DataFrame:
    """Runs of rows where `on` holds: recording_id, island, t0_us, t1_us, n."""
    flag = F.coalesce(on, F.lit(False)).cast("int")
    f = df.withColumn("on", flag).withColumn("start", ((F.col("on") == 1) & (F.coalesce(F.lag("on").over(in_time()), F.lit(0)) == 0)).cast("int"))
    f = f.withColumn("island", F.sum("start").over(in_time()).cast("long")).where("on = 1")
    return f.groupBy("recording_id", "island").agg(F.min("t_us").alias("t0_us"), F.max("t_us").alias("t1_us"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_rows)


def spans(df: DataFrame, on: Column) -> DataFrame:
    """Runs where `on` holds, each up to the first row where it does not (the last row if it never ends)."""
    f = df.withColumn("on", F.coalesce(on, F.lit(False)).cast("int"))
    f = f.withColumn("was", F.coalesce(F.lag("on").over(in_time()), F.lit(0)))
    edges = f.where(F.col("on") != F.col("was")).withColumn("end", F.lead("t_us").over(in_time())).where("on = 1")
    last = df.groupBy("recording_id").agg(F.max("t_us").alias("last"))
    return edges.join(last, "recording_id").select("recording_id", F.col("t_us").alias("t0_us"), F.coalesce("end", "last").alias("t1_us"))


def restart_segments(df: DataFrame) -> DataFrame:
    """df with segment, which rises where time steps back in the order of the file."""
    back = F.coalesce(F.col("t_us") < F.lag("t_us").over(in_file()), F.lit(False)).cast("int")
    return df.withColumn("back", back).withColumn("segment", F.sum("back").over(in_file()).cast("long")).drop("back")


def unwrapped(df: DataFrame, turn: float = 360.0) -> DataFrame:
    """df with unwrapped: value without jumps over half a turn; nulls are bridged."""
    step = F.col("value") - F.last("value", ignorenulls=True).over(in_time().rowsBetween(W.unboundedPreceding, -1))
    turns = F.when(F.col("value").isNotNull(), -F.floor(F.coalesce(step, F.lit(0.0)) / turn + 0.5)).otherwise(0)
    return df.withColumn("turns", turns).withColumn("unwrapped", F.col("value") + turn * F.sum("turns").over(in_time())).drop("turns")


def coast_gaps(df: DataFrame, least_us: int) -> DataFrame:
    """Intervals of at least least_us between rows, with the change of value over each."""
    d = df.withColumn("t0_us", F.lag("t_us").over(in_time())).withColumn("v0", F.lag("value").over(in_time()))
    return d.where(F.col("t_us") - F.col("t0_us") >= least_us).select("recording_id", "t0_us", F.col("t_us").alias("t1_us"), ((F.col("t_us") - F.col("t0_us")) / 1e6).alias("gap_s"), F.abs(F.col("value") - F.col("v0")).alias("moved"))


def min_max_thinned(df: DataFrame, points: int) -> DataFrame:
    """For each of points / 2 buckets of equal row counts, the rows of the least and the greatest value (the first of equals)."""
    n = F.count(F.lit(1)).over(by_recording())
    b = df.withColumn("bucket", F.floor((F.row_number().over(in_time()) - 1) * (points // 2) / n).cast("long"))
    low = W.partitionBy("recording_id", "bucket").orderBy(F.col("value").asc_nulls_last(), "t_us", "seq")
    high = W.partitionBy("recording_id", "bucket").orderBy(F.col("value").desc_nulls_last(), "t_us", "seq")
    return b.withColumn("lo", F.row_number().over(low)).withColumn("hi", F.row_number().over(high)).where("lo = 1 OR hi = 1").drop("lo", "hi")


def first_per_period(df: DataFrame, period_us: int) -> DataFrame:
    """The first row in each period from the recording's start."""
    k = F.floor((F.col("t_us") - F.min("t_us").over(by_recording())) / period_us).cast("long")
    b = df.withColumn("period", k)
    return b.withColumn("r", F.row_number().over(W.partitionBy("recording_id", "period").orderBy("t_us", "seq"))).where("r = 1").drop("r")
