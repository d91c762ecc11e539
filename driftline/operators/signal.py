"""Allan deviation, correlation at lags, robust fits. A stream has recording_id, t_us, seq and value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

#: Fixed value: sqrt(2 ln 2 / pi), the ratio of a curve's floor to the bias instability.
FLOOR_FACTOR = 0.6642824702679600


def by_recording() -> WindowSpec:
    return W.partitionBy("recording_id")


def in_time() -> WindowSpec:
    return by_recording().orderBy("t_us", "seq")


def allan_deviation(df: DataFrame, tau0: float, factors: list[int]) -> DataFrame:
    """Overlapping Allan deviation of value as a rate, at tau = m * tau0, from the running sum.

    Each factor looks m and 2 m rows ahead in the same sorted pass, so that rows are not joined.
    """
    total = F.sum("value").over(in_time().rowsBetween(W.unboundedPreceding, -1))
    n = F.count(F.lit(1)).over(by_recording())
    p = df.select("recording_id", "t_us", "seq", (F.coalesce(total, F.lit(0.0)) * tau0).alias("x"), (F.coalesce(total, F.lit(0.0)) * tau0 + F.col("value") * tau0).alias("end"), n.alias("n"))
    # The running sum after the last row is one more point; it stands behind row n - 1.
    ahead = lambda m: F.when(F.row_number().over(in_time()) - 1 + m == F.col("n"), F.last("end").over(in_time().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).otherwise(F.lead("x", m).over(in_time()))
    cols = [(ahead(2 * m) - 2 * ahead(m) + F.col("x")).alias(f"d{m}") for m in factors]
    d = p.select("recording_id", *cols)
    sums = d.groupBy("recording_id").agg(*(F.sum(F.col(f"d{m}") * F.col(f"d{m}")).alias(f"s{m}") for m in factors), *(F.count(f"d{m}").alias(f"c{m}") for m in factors))
    rows = F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.col(f"s{m}").alias("s"), F.col(f"c{m}").alias("c")) for m in factors)))
    flat = sums.select("recording_id", rows.alias("r")).select("recording_id", "r.*").where("c > 0")
    tau = F.col("m") * tau0
    return flat.select("recording_id", "m", tau.alias("tau_s"), F.col("c").alias("pairs"), F.sqrt(F.col("s") / (2 * tau * tau * F.col("c"))).alias("adev"))


def bias_instability(adev: DataFrame) -> DataFrame:
    """Least deviation / sqrt(2 ln 2 / pi) and its tau, of equals the first."""
    return adev.groupBy("recording_id").agg((F.min("adev") / FLOOR_FACTOR).alias("bias_instability"), F.min_by("tau_s", F.struct("adev", "tau_s")).alias("tau_s"))


def asymptote(adev: DataFrame, slope: float, tau_ref: float) -> DataFrame:
    """Value at tau_ref of the power law with this slope that fits best: the geometric mean over the taus."""
    log = F.log("adev") - slope * (F.log("tau_s") - F.log(F.lit(tau_ref)))
    return adev.where("adev > 0").groupBy("recording_id").agg(F.exp(F.avg(log)).alias("coefficient"), F.count(F.lit(1)).alias("taus"))


def lag_correlation(df: DataFrame, x: str, y: str, lags: list[int], least: int = 10) -> DataFrame:
    """Correlation of x with y `lag` rows later, means removed over the recording; lags with few pairs are left out."""
    c = df.withColumns({"cx": F.col(x) - F.avg(x).over(by_recording()), "cy": F.col(y) - F.avg(y).over(by_recording())})
    c = c.select("recording_id", "cx", *((F.lead("cy", k) if k >= 0 else F.lag("cy", -k)).over(in_time()).alias(f"y{i}") for i, k in enumerate(lags)))
    aggs = []
    for i in range(len(lags)):
        both = F.col("cx").isNotNull() & F.col(f"y{i}").isNotNull()
        on = lambda e, both=both: F.sum(F.when(both, e))
        aggs.append(F.struct(F.lit(lags[i]).cast("long").alias("lag"), on(F.lit(1)).alias("n"), (on(F.col("cx") * F.col(f"y{i}")) / F.sqrt(on(F.col("cx") * F.col("cx")) * on(F.col(f"y{i}") * F.col(f"y{i}")))).alias("r")).alias(f"s{i}"))
    g = c.groupBy("recording_id").agg(*aggs)
    return g.select("recording_id", F.explode(F.array(*(F.col(f"s{i}") for i in range(len(lags))))).alias("s")).select("recording_id", "s.*").where((F.col("n") >= least) & F.col("r").isNotNull())


def correlation_peak(curve: DataFrame) -> DataFrame:
    """The lag of the highest correlation, of equals the first."""
    return curve.groupBy("recording_id").agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("lag"), F.max("r").alias("r"))


def scale_through_origin(df: DataFrame, by: list[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted least squares y = scale * x: scale, its sigma inflated by the reduced chi-square if over 1, and the weighted rms."""
    s = lambda e: F.sum(F.col(w) * e)
    x_, y_ = F.col(x), F.col(y)
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), s(x_ * x_).alias("xx"), s(x_ * y_).alias("xy"), s(y_ * y_).alias("yy"), F.sum(w).alias("sw"))
    scale = F.col("xy") / F.col("xx")
    rest = F.greatest(F.col("yy") - scale * F.col("xy"), F.lit(0.0))
    inflate = F.sqrt(F.greatest(rest / (F.col("n") - 1), F.lit(1.0)))
    return g.where("n > 1 AND xx > 0").select(*by, "n", scale.alias("scale"), (inflate / F.sqrt("xx")).alias("sigma"), F.sqrt(rest / F.col("sw")).alias("weighted_rms"))


def robust_spread(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """True median and 1.4826 times the median absolute deviation from it."""
    m = df.groupBy(*by).agg(F.median(x).alias("median"))
    return df.join(m, by).groupBy(*by).agg(F.first("median").alias("median"), (1.4826 * F.median(F.abs(F.col(x) - F.col("median")))).alias("mad_sigma"))


def line_fit(df: DataFrame, by: list[str], x: str, y: str, reject: float | None = None, rounds: int = 5) -> DataFrame:
    """y = a + b x by least squares; with reject, rows farther off than that go and the rest is fitted again, up to `rounds` times."""
    mean = df.groupBy(*by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    rows = df.join(mean, by).select(*by, (F.col(x) - F.col("mx")).alias("x"), (F.col(y) - F.col("my")).alias("y"), "mx", "my")

    def fitted(r: DataFrame) -> DataFrame:
        g = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("c"), F.first("mx").alias("mx"), F.first("my").alias("my"))
        return g.select(*by, "n", "b", "c", (F.col("c") + F.col("my") - F.col("b") * F.col("mx")).alias("a"))

    fit = fitted(rows)
    for _ in range(rounds if reject is not None else 0):
        f = fit.select(*by, F.col("b").alias("fb"), F.col("c").alias("fc"))
        fit = fitted(rows.join(f, by).where(F.abs(F.col("y") - F.col("fc") - F.col("fb") * F.col("x")) <= reject).drop("fb", "fc"))
    return fit.select(*by, "n", "a", "b")
