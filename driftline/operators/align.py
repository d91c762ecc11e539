"""Joins of streams in time. Both sides have recording_id, t_us and seq; ties go by seq.

Each join is a union of both sides and running windows over the recording, forwards
and where need be backwards: it shuffles once by the recording, sorts, and never
pairs rows beyond those it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _both(base: DataFrame, aux: DataFrame) -> DataFrame:
    """Rows of both with `side` (aux stands before base at equal times), base's and aux's columns as structs b and a."""
    one = base.select("recording_id", "t_us", "seq", F.struct("t_us", "seq", "value").alias("b"), F.lit(None).cast("struct<t_us:bigint,seq:bigint,value:double>").alias("a"), F.lit(1).alias("side"))
    two = aux.select("recording_id", "t_us", "seq", F.lit(None).cast("struct<t_us:bigint,seq:bigint,value:double>").alias("b"), F.struct("t_us", "seq", "value").alias("a"), F.lit(0).alias("side"))
    return one.unionByName(two)


def _order():
    return W.partitionBy("recording_id").orderBy("t_us", "side", "seq").rowsBetween(W.unboundedPreceding, 0)


def _turned():
    """The same order from its end, so that what follows a row is a running value, not a frame to go through again."""
    return W.partitionBy("recording_id").orderBy(F.desc("t_us"), F.desc("side"), F.desc("seq")).rowsBetween(W.unboundedPreceding, 0)


def newest_only(base: DataFrame, aux: DataFrame) -> DataFrame:
    """Each base row with the newest aux row at or before it that no earlier base row has met; older ones are lost."""
    u = _both(base, aux)
    nxt = F.last("b", ignorenulls=True).over(_turned())
    met = u.withColumn("e", nxt).where(F.col("a").isNotNull() & F.col("e").isNotNull())
    last = W.partitionBy("recording_id", "e.t_us", "e.seq").orderBy(F.desc("t_us"), F.desc("seq"))
    return met.withColumn("k", F.row_number().over(last)).where("k = 1").select("recording_id", F.col("e.t_us").alias("t_us"), F.col("e.seq").alias("seq"), F.col("e.value").alias("value"), F.col("a.t_us").alias("aux_t_us"), F.col("a.value").alias("aux_value"), (F.col("e.t_us") - F.col("a.t_us")).alias("age_us"))


def backward(base: DataFrame, aux: DataFrame, max_age_us: int | None = None) -> DataFrame:
    """Each base row with the last aux row at or before it, within max_age_us; null if there is none."""
    u = _both(base, aux)
    prev = F.last("a", ignorenulls=True).over(_order())
    out = u.withColumn("p", prev).where(F.col("b").isNotNull())
    ok = F.col("b.t_us") - F.col("p.t_us") <= max_age_us if max_age_us is not None else F.col("p").isNotNull()
    return out.select("recording_id", "b.t_us", "b.seq", "b.value", F.when(ok, F.col("p.t_us")).alias("aux_t_us"), F.when(ok, F.col("p.value")).alias("aux_value"))


def _bracketed(base: DataFrame, aux: DataFrame) -> DataFrame:
    u = _both(base, aux)
    prev = F.last("a", ignorenulls=True).over(_order())
    nxt = F.last("a", ignorenulls=True).over(_turned())
    return u.withColumn("p", prev).withColumn("n", nxt).where(F.col("b").isNotNull())


def nearest(base: DataFrame, aux: DataFrame, tolerance_us: int) -> DataFrame:
    """Each base row with the nearest aux row on either side, the earlier of two as near, within the tolerance."""
    back, ahead = F.col("b.t_us") - F.col("p.t_us"), F.col("n.t_us") - F.col("b.t_us")
    pick = F.when(ahead.isNull() | (back <= ahead), F.col("p")).otherwise(F.col("n"))
    out = _bracketed(base, aux).withColumn("c", pick)
    ok = F.abs(F.col("c.t_us") - F.col("b.t_us")) <= tolerance_us
    return out.select("recording_id", "b.t_us", "b.seq", "b.value", F.when(ok, F.col("c.t_us")).alias("aux_t_us"), F.when(ok, F.col("c.value")).alias("aux_value"))


def interpolated(base: DataFrame, aux: DataFrame, max_gap_us: int) -> DataFrame:
    """Each base row with aux interpolated between the rows around it; null outside them or over a longer gap."""
    gap = F.col("n.t_us") - F.col("p.t_us")
    at = F.when(gap > 0, (F.col("b.t_us") - F.col("p.t_us")) / gap).otherwise(0.0)
    value = F.when((gap <= max_gap_us) & F.col("p").isNotNull() & F.col("n").isNotNull(), F.col("p.value") + at * (F.col("n.value") - F.col("p.value")))
    exact = F.col("p.t_us") == F.col("b.t_us")
    return _bracketed(base, aux).select("recording_id", "b.t_us", "b.seq", "b.value", F.when(exact, F.col("p.value")).otherwise(value).alias("aux_value"))


def at_validity(measured: DataFrame, states: DataFrame, span_us: int, near_us: int, oldest_us: int) -> DataFrame:
    """Each measured row (with an age_us) with the state at its time of validity: recording_id, t_us, seq, value, state, rest_us, how.

    how: 'between' where states at or before and after the time of validity, the latter not later than the row itself, lie
    within span_us; else 'held', the nearer of the two, if it is within near_us, with rest_us from it to the time of
    validity; else 'none', as for an age over oldest_us.
    """
    state, own = "struct<t_us:bigint,value:double>", "struct<t_us:bigint,age_us:bigint,value:double>"
    one = states.select("recording_id", "t_us", "seq", F.struct("t_us", "value").alias("a"), F.lit(None).cast(own).alias("b"), F.lit(0).alias("side"))
    two = measured.select("recording_id", (F.col("t_us") - F.col("age_us")).alias("t_us"), "seq", F.lit(None).cast(state).alias("a"), F.struct("t_us", F.col("age_us").cast("long").alias("age_us"), "value").alias("b"), F.lit(1).alias("side"))
    u = one.unionByName(two).withColumn("p", F.last("a", ignorenulls=True).over(_order())).withColumn("n", F.last("a", ignorenulls=True).over(_turned())).where(F.col("b").isNotNull())
    u = u.withColumn("n", F.when(F.col("n.t_us") <= F.col("b.t_us"), F.col("n")))
    back, ahead = F.col("t_us") - F.col("p.t_us"), F.col("n.t_us") - F.col("t_us")
    near = F.when(F.col("n").isNull() | (back < ahead), F.col("p")).otherwise(F.col("n"))
    fresh = F.col("b.age_us") <= oldest_us
    how = F.when(fresh & (back + ahead <= span_us), "between").when(fresh & (F.abs(F.col("t_us") - F.col("c.t_us")) <= near_us), "held").otherwise("none")
    u = u.withColumn("c", near).withColumn("how", how)
    between = F.col("p.value") + F.when(back + ahead > 0, back / (back + ahead)).otherwise(0.0) * (F.col("n.value") - F.col("p.value"))
    return u.select(
        "recording_id", F.col("b.t_us").alias("t_us"), "seq", F.col("b.value").alias("value"), F.when(F.col("how") == "between", between).when(F.col("how") == "held", F.col("c.value")).alias("state"),
        F.when(F.col("how") == "between", F.lit(0)).when(F.col("how") == "held", F.col("t_us") - F.col("c.t_us")).cast("long").alias("rest_us"), "how",
    )


def fifo(base: DataFrame, aux: DataFrame, capacity: int = 4) -> DataFrame:
    """aux rows with the epoch that takes each: first come first served, `capacity` to an epoch, the rest carried on.

    An aux row i that may first go to epoch a_i takes slot i + max over j <= i of (capacity * a_j - j).
    """
    w = W.partitionBy("recording_id").orderBy("t_us", "seq")
    epochs = base.select("recording_id", "t_us", "seq", (F.row_number().over(w) - 1).alias("epoch"))
    total = epochs.groupBy("recording_id").agg(F.count(F.lit(1)).alias("epochs"))
    u = epochs.select("recording_id", "t_us", "seq", "epoch", F.lit(None).cast("double").alias("value"), F.lit(1).alias("side")).unionByName(aux.select("recording_id", "t_us", "seq", F.lit(None).cast("int").alias("epoch"), "value", F.lit(0).alias("side")))
    first = F.last("epoch", ignorenulls=True).over(_turned())
    a = u.withColumn("a", first).where((F.col("side") == 0) & F.col("a").isNotNull()).withColumn("i", F.row_number().over(w) - 1)
    slot = F.col("i") + F.max(capacity * F.col("a") - F.col("i")).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = a.withColumn("epoch", F.floor(slot / capacity)).join(total, "recording_id")
    return out.where(F.col("epoch") < F.col("epochs")).select("recording_id", "t_us", "seq", "value", F.col("a").cast("long").alias("offered"), F.col("epoch").cast("long").alias("epoch"), (F.col("epoch") - F.col("a")).cast("long").alias("carried"))


def outage_cut(df: DataFrame, windows: list[tuple[float, float]]) -> DataFrame:
    """df without rows in half-open windows of seconds (start, duration) from each recording's start."""
    t = (F.col("t_us") - F.min("t_us").over(W.partitionBy("recording_id"))) / 1e6
    out = df.withColumn("__t", t)
    for start, duration in windows:
        out = out.where(~((F.col("__t") >= start) & (F.col("__t") < start + duration)))
    return out.drop("__t")
