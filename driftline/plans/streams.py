"""Queries over the events table as streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import align, filters, gates, quality, signal, windows
from driftline.sources.streams import events

D6 = 6
EVENTS = "ev AS (SELECT user_id AS recording_id, epoch_us(ts) AS t_us, event_id AS seq, event_type AS stream, value FROM events)"


def rounded(df: DataFrame, **casts: str) -> DataFrame:
    """Doubles to six digits, and casts where a type has to match."""
    out = []
    for name, kind in df.dtypes:
        c = F.round(name, D6) if kind == "double" else F.col(name)
        out.append((c.cast(casts[name]) if name in casts else c).alias(name))
    return df.select(*out)


def _of(df: DataFrame, *kinds: str) -> DataFrame:
    return df.where(F.col("stream").isin(*kinds)).select("recording_id", "t_us", "seq", "value")


def _base(spark: SparkSession, d: str) -> DataFrame:
    return _of(events(spark, d), "view")


def _aux(spark: SparkSession, d: str) -> DataFrame:
    return _of(events(spark, d), "click", "purchase", "signup")


BASE = f"{EVENTS}, base AS (SELECT * FROM ev WHERE stream = 'view'), aux AS (SELECT * FROM ev WHERE stream IN ('click', 'purchase', 'signup'))"


def gap_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.gap_statistics(events(spark, d)))


GAP_STATISTICS = f"""
WITH {EVENTS}, g AS (SELECT *, t_us - lag(t_us) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY recording_id ORDER BY t_us, seq)),
r AS (SELECT recording_id, count(*) AS n, min(t_us) AS t0, max(t_us) AS t1, max(gap) AS gap FROM g GROUP BY 1),
a AS (SELECT g.recording_id, min(g.t_us) AS at_us FROM g JOIN r ON g.recording_id = r.recording_id AND g.gap = r.gap GROUP BY 1)
SELECT recording_id, n, round((t1 - t0) / 1e6, 6) AS duration_s, round(CASE WHEN t1 > t0 THEN (n - 1) / ((t1 - t0) / 1e6) ELSE 0.0 END, 6) AS avg_hz,
  round(CASE WHEN gap > 0 THEN gap / 1e6 ELSE 0.0 END, 6) AS max_gap_s, round(CASE WHEN gap > 0 THEN (at_us - t0) / 1e6 ELSE 0.0 END, 6) AS max_gap_at_s
FROM r LEFT JOIN a USING (recording_id)
"""


def bucketed_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.bucketed_rate(events(spark, d), 86400.0))


BUCKETED_RATE = f"""
WITH {EVENTS}, b AS (SELECT recording_id, CAST(trunc((t_us - min(t_us) OVER (PARTITION BY recording_id)) / 1e6 / 86400.0) AS BIGINT) AS bucket FROM ev),
c AS (SELECT recording_id, bucket, count(*) AS n FROM b GROUP BY 1, 2),
s AS (SELECT recording_id, unnest(generate_series(0, max(bucket))) AS bucket FROM c GROUP BY recording_id)
SELECT recording_id, bucket, coalesce(n, 0) AS n, round(coalesce(n, 0) / 86400.0, 6) AS hz FROM s LEFT JOIN c USING (recording_id, bucket)
"""


def difference_noise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.difference_noise(events(spark, d), 12 * 3600 * 1_000_000))


DIFFERENCE_NOISE = f"""
WITH {EVENTS}, l AS (SELECT recording_id, value AS v0, lag(value, 1) OVER w AS v1, lag(value, 2) OVER w AS v2, lag(value, 3) OVER w AS v3,
  t_us - lag(t_us, 1) OVER w AS g0, lag(t_us, 1) OVER w - lag(t_us, 2) OVER w AS g1, lag(t_us, 2) OVER w - lag(t_us, 3) OVER w AS g2
  FROM ev WINDOW w AS (PARTITION BY recording_id ORDER BY t_us, seq)),
x AS (SELECT recording_id, CASE WHEN g0 > 0 AND g0 < 43200000000 AND g1 > 0 AND g1 < 43200000000 THEN v0 - 2 * v1 + v2 END AS d2,
  CASE WHEN g0 > 0 AND g0 < 43200000000 AND g1 > 0 AND g1 < 43200000000 AND g2 > 0 AND g2 < 43200000000 THEN v0 - 3 * v1 + 3 * v2 - v3 END AS d3 FROM l),
g AS (SELECT recording_id, count(d2) AS n2, count(d3) AS n3, var_pop(d2) AS s2, var_pop(d3) AS s3 FROM x GROUP BY 1)
SELECT recording_id, n2, n3, round(CASE WHEN n2 > 1 THEN sqrt(s2 / 6) END, 6) AS noise,
  round(CASE WHEN n3 > 1 AND s2 > 0 THEN s3 / s2 END, 6) AS ratio, CASE WHEN n3 > 1 AND s2 > 0 THEN s3 / s2 END < 2.5 AS band_limited FROM g
"""


def newest_only_attach(spark: SparkSession, d: str) -> DataFrame:
    return rounded(align.newest_only(_base(spark, d), _aux(spark, d)))


NEWEST_ONLY_ATTACH = f"""
WITH {BASE}, e AS (
  SELECT a.recording_id, a.t_us AS aux_t_us, a.value AS aux_value, a.seq AS aux_seq,
    (SELECT min(t_us) FROM base b WHERE b.recording_id = a.recording_id AND b.t_us >= a.t_us) AS t_us FROM aux a
), f AS (SELECT e.*, row_number() OVER (PARTITION BY recording_id, t_us ORDER BY aux_t_us DESC, aux_seq DESC) AS k FROM e WHERE t_us IS NOT NULL)
SELECT f.recording_id, b.t_us, b.seq, round(b.value, 6) AS value, aux_t_us, round(aux_value, 6) AS aux_value, b.t_us - aux_t_us AS age_us
FROM f JOIN (SELECT *, row_number() OVER (PARTITION BY recording_id, t_us ORDER BY seq) AS r FROM base) b ON b.recording_id = f.recording_id AND b.t_us = f.t_us AND r = 1 WHERE k = 1
"""


def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return rounded(align.backward(_base(spark, d), _aux(spark, d), 86_400_000_000))


ASOF_BACKWARD = f"""
WITH {BASE}
SELECT b.recording_id, b.t_us, b.seq, round(b.value, 6) AS value, CASE WHEN b.t_us - a.t_us <= 86400000000 THEN a.t_us END AS aux_t_us,
  CASE WHEN b.t_us - a.t_us <= 86400000000 THEN round(a.value, 6) END AS aux_value
FROM base b ASOF LEFT JOIN aux a ON b.recording_id = a.recording_id AND b.t_us >= a.t_us
"""


def nearest_join(spark: SparkSession, d: str) -> DataFrame:
    return rounded(align.nearest(_base(spark, d), _aux(spark, d), 43_200_000_000))


_AROUND = """around AS (
  SELECT b.*, p.t_us AS pt, p.value AS pv, n.t_us AS nt, n.value AS nv FROM (SELECT * FROM base) b
  ASOF LEFT JOIN aux p ON b.recording_id = p.recording_id AND b.t_us >= p.t_us
  ASOF LEFT JOIN aux n ON b.recording_id = n.recording_id AND b.t_us < n.t_us
)"""
NEAREST_JOIN = f"""
WITH {BASE}, {_AROUND}, c AS (SELECT *, CASE WHEN nt IS NULL OR t_us - pt <= nt - t_us THEN pt ELSE nt END AS ct, CASE WHEN nt IS NULL OR t_us - pt <= nt - t_us THEN pv ELSE nv END AS cv FROM around)
SELECT recording_id, t_us, seq, round(value, 6) AS value, CASE WHEN abs(ct - t_us) <= 43200000000 THEN ct END AS aux_t_us, CASE WHEN abs(ct - t_us) <= 43200000000 THEN round(cv, 6) END AS aux_value FROM c
"""


def interpolated_join(spark: SparkSession, d: str) -> DataFrame:
    return rounded(align.interpolated(_base(spark, d), _aux(spark, d), 172_800_000_000))


INTERPOLATED_JOIN = f"""
WITH {BASE}, {_AROUND}
SELECT recording_id, t_us, seq, round(value, 6) AS value,
  round(CASE WHEN pt = t_us THEN pv WHEN nt - pt <= 172800000000 THEN pv + (t_us - pt) / (nt - pt) * (nv - pv) END, 6) AS aux_value FROM around
"""


def fifo_capacity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(align.fifo(_of(events(spark, d), "purchase"), _of(events(spark, d), "view", "click"), 4))


FIFO_CAPACITY = f"""
WITH {EVENTS}, base AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_us, seq) - 1 AS e FROM ev WHERE stream = 'purchase'),
tot AS (SELECT recording_id, count(*) AS epochs FROM base GROUP BY 1),
aux AS (SELECT * FROM ev WHERE stream IN ('view', 'click')),
a AS (SELECT x.*, (SELECT min(e) FROM base b WHERE b.recording_id = x.recording_id AND b.t_us >= x.t_us) AS a FROM aux x),
i AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_us, seq) - 1 AS i FROM a WHERE a IS NOT NULL),
s AS (SELECT *, CAST(floor((i + max(4 * a - i) OVER (PARTITION BY recording_id ORDER BY t_us, seq)) / 4) AS BIGINT) AS epoch FROM i)
SELECT recording_id, t_us, seq, round(value, 6) AS value, a AS offered, epoch, epoch - a AS carried FROM s JOIN tot USING (recording_id) WHERE epoch < epochs
"""


def outage_cut(spark: SparkSession, d: str) -> DataFrame:
    cut = align.outage_cut(events(spark, d), [(86400.0, 172800.0), (604800.0, 86400.0)])
    return rounded(cut.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


OUTAGE_CUT = f"""
WITH {EVENTS}, t AS (SELECT *, (t_us - min(t_us) OVER (PARTITION BY recording_id)) / 1e6 AS s FROM ev)
SELECT recording_id, count(*) AS n, round(sum(value), 6) AS total FROM t WHERE NOT (s >= 86400 AND s < 259200) AND NOT (s >= 604800 AND s < 691200) GROUP BY 1
"""


def coast_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.coast_gaps(events(spark, d), 43_200_000_000))


COAST_GAPS = f"""
WITH {EVENTS}, g AS (SELECT recording_id, lag(t_us) OVER w AS t0_us, t_us AS t1_us, lag(value) OVER w AS v0, value FROM ev WINDOW w AS (PARTITION BY recording_id ORDER BY t_us, seq))
SELECT recording_id, t0_us, t1_us, round((t1_us - t0_us) / 1e6, 6) AS gap_s, round(abs(value - v0), 6) AS moved FROM g WHERE t1_us - t0_us >= 43200000000
"""


def session_split(spark: SparkSession, d: str) -> DataFrame:
    s = windows.sessions(events(spark, d))
    return rounded(s.groupBy("recording_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("t0_us"), F.max("t_us").alias("t1_us")))


_SESSIONS = """g AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY recording_id ORDER BY t_us, seq) AS gap FROM ev),
m AS (SELECT recording_id, list_sort(list(gap))[CAST(floor(count(gap) / 2) AS BIGINT) + 1] AS typical FROM g WHERE gap IS NOT NULL GROUP BY 1),
s AS (SELECT g.*, CAST(sum(CASE WHEN gap > 5 * typical THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY t_us, seq) AS BIGINT) AS session FROM g LEFT JOIN m USING (recording_id))"""
SESSION_SPLIT = f"WITH {EVENTS}, {_SESSIONS} SELECT recording_id, session, count(*) AS n, min(t_us) AS t0_us, max(t_us) AS t1_us FROM s GROUP BY 1, 2"


def block_decimate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.block_means(windows.sessions(events(spark, d)), 4, ("recording_id", "session")))


BLOCK_DECIMATE = f"""
WITH {EVENTS}, {_SESSIONS}, b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY recording_id, session ORDER BY t_us, seq) - 1) / 4) AS BIGINT) AS block FROM s)
SELECT recording_id, session, block, max(t_us) AS t_us, round(avg(value), 6) AS value FROM b GROUP BY 1, 2, 3 HAVING count(*) = 4
"""


def rolling_variance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.rolling_variance(events(spark, d), 11).select("recording_id", "t_us", "seq", "variance"))


_ROLLING = """r AS (SELECT *, CASE WHEN count(value) OVER w = 11 THEN greatest(var_samp(value) OVER w, 0.0) END AS variance FROM ev
  WINDOW w AS (PARTITION BY recording_id ORDER BY t_us, seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))"""
ROLLING_VARIANCE = f"WITH {EVENTS}, {_ROLLING} SELECT recording_id, t_us, seq, round(variance, 6) AS variance FROM r"


def static_intervals(spark: SparkSession, d: str) -> DataFrame:
    return windows.islands(windows.rolling_variance(events(spark, d), 11), F.col("variance") < 4000.0, 3)


STATIC_INTERVALS = f"""
WITH {EVENTS}, {_ROLLING}, f AS (SELECT *, coalesce(variance < 4000, false) AS still FROM r),
s AS (SELECT *, CASE WHEN still AND NOT coalesce(lag(still) OVER w, false) THEN 1 ELSE 0 END AS start FROM f WINDOW w AS (PARTITION BY recording_id ORDER BY t_us, seq)),
i AS (SELECT *, CAST(sum(start) OVER (PARTITION BY recording_id ORDER BY t_us, seq) AS BIGINT) AS island FROM s)
SELECT recording_id, island, min(t_us) AS t0_us, max(t_us) AS t1_us, count(*) AS n FROM i WHERE still GROUP BY 1, 2 HAVING count(*) >= 3
"""


def state_spans(spark: SparkSession, d: str) -> DataFrame:
    return windows.spans(events(spark, d), F.col("value") > 60.0)


STATE_SPANS = f"""
WITH {EVENTS}, f AS (SELECT *, value > 60 AS on_, coalesce(lag(value > 60) OVER w, false) AS was FROM ev WINDOW w AS (PARTITION BY recording_id ORDER BY t_us, seq)),
e AS (SELECT *, lead(t_us) OVER (PARTITION BY recording_id ORDER BY t_us, seq) AS nxt FROM f WHERE on_ <> was),
l AS (SELECT recording_id, max(t_us) AS last FROM ev GROUP BY 1)
SELECT recording_id, t_us AS t0_us, coalesce(nxt, last) AS t1_us FROM e JOIN l USING (recording_id) WHERE on_
"""


def restart_segments(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    t = F.unix_micros(F.from_utc_timestamp(F.col("o_orderdate").cast("timestamp"), F.current_timezone()))
    s = o.select(F.col("o_custkey").alias("recording_id"), t.alias("t_us"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return windows.restart_segments(s).groupBy("recording_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("t0_us"))


RESTART_SEGMENTS = """
WITH o AS (SELECT o_custkey AS recording_id, epoch_us(o_orderdate) AS t_us, o_orderkey AS seq FROM orders),
b AS (SELECT *, CASE WHEN t_us < lag(t_us) OVER (PARTITION BY recording_id ORDER BY seq) THEN 1 ELSE 0 END AS back FROM o),
s AS (SELECT *, CAST(sum(back) OVER (PARTITION BY recording_id ORDER BY seq) AS BIGINT) AS segment FROM b)
SELECT recording_id, segment, count(*) AS n, min(t_us) AS t0_us FROM s GROUP BY 1, 2
"""


def unwrapped_angle(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("value", F.pmod(F.col("value") * 7, F.lit(360.0)))
    return rounded(windows.unwrapped(e).select("recording_id", "t_us", "seq", "unwrapped"))


UNWRAPPED_ANGLE = f"""
WITH {EVENTS}, a AS (SELECT *, (value * 7) % 360.0 AS v FROM ev),
s AS (SELECT *, -floor(coalesce(v - lag(v) OVER w, 0.0) / 360.0 + 0.5) AS turns FROM a WINDOW w AS (PARTITION BY recording_id ORDER BY t_us, seq))
SELECT recording_id, t_us, seq, round(v + 360.0 * sum(turns) OVER (PARTITION BY recording_id ORDER BY t_us, seq), 6) AS unwrapped FROM s
"""


def score_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("error", F.col("value") - 50.0)
    return rounded(quality.score_statistics(e, ["recording_id", "stream"], "error"))


SCORE_STATISTICS = f"""
WITH {EVENTS}, e AS (SELECT *, value - 50.0 AS x FROM ev)
SELECT recording_id, stream, count(x) AS n, round(avg(x), 6) AS mean, round(CASE WHEN count(x) < 2 THEN 0.0 ELSE stddev_pop(x) END, 6) AS std, round(sqrt(avg(x * x)), 6) AS rms, round(max(abs(x)), 6) AS max_abs
FROM e GROUP BY 1, 2
"""


def order_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.order_statistics(events(spark, d), ["recording_id"], "value"))


ORDER_STATISTICS = f"""
WITH {EVENTS}, s AS (SELECT recording_id, list_sort(list(value)) AS s, count(*) AS n FROM ev GROUP BY 1)
SELECT recording_id, n, round(s[CAST(floor(n / 2) AS BIGINT) + 1], 6) AS upper_median, round((s[CAST(floor((n - 1) / 2) AS BIGINT) + 1] + s[CAST(floor(n / 2) AS BIGINT) + 1]) / 2, 6) AS median,
  round(s[CAST(floor(0.05 * (n - 1) + 0.5) AS BIGINT) + 1], 6) AS p5, round(s[CAST(floor(0.95 * (n - 1) + 0.5) AS BIGINT) + 1], 6) AS p95 FROM s
"""


def pooled_phase_std(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.pooled_std(events(spark, d), ["recording_id"], ["stream"], "value", 4))


POOLED_PHASE_STD = f"""
WITH {EVENTS}, p AS (SELECT recording_id, stream, count(value) AS n, var_samp(value) AS v FROM ev GROUP BY 1, 2 HAVING count(value) >= 4)
SELECT recording_id, count(*) AS phases, round(sqrt(sum(v * (n - 1)) / sum(n - 1)), 6) AS pooled_std FROM p GROUP BY 1
"""


def quality_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.shares(events(spark, d), ["recording_id"], F.when(F.col("stream") != "error", F.col("stream"))))


QUALITY_SHARES = f"""
WITH {EVENTS}, c AS (SELECT recording_id, stream AS kind, count(*) AS n FROM ev WHERE stream <> 'error' GROUP BY 1, 2)
SELECT recording_id, kind, n, round(n / sum(n) OVER (PARTITION BY recording_id), 6) AS share FROM c
"""


def start_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.start_mean(events(spark, d), 7 * 86_400_000_000))


START_MEAN = f"""
WITH {EVENTS}, s AS (SELECT *, min(t_us) OVER (PARTITION BY recording_id) AS t0 FROM ev)
SELECT recording_id, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN avg(value) END, 6) AS bias FROM s WHERE t_us - t0 <= 604800000000 GROUP BY 1
"""

LAGS = list(range(-4, 5))


def lag_correlation(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("other", F.col("value") * F.col("value"))
    return rounded(signal.lag_correlation(e, "value", "other", LAGS))


_CURVE = """c AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY t_us, seq) AS i, value - avg(value) OVER (PARTITION BY recording_id) AS x, value * value - avg(value * value) OVER (PARTITION BY recording_id) AS y FROM ev),
k AS (SELECT a.recording_id, b.i - a.i AS lag, count(*) AS n, sum(a.x * b.y) / sqrt(sum(a.x * a.x) * sum(b.y * b.y)) AS r FROM c a JOIN c b ON a.recording_id = b.recording_id AND b.i - a.i BETWEEN -4 AND 4 GROUP BY 1, 2 HAVING count(*) >= 10)"""
LAG_CORRELATION = f"WITH {EVENTS}, {_CURVE} SELECT recording_id, lag, n, round(r, 6) AS r FROM k"


def correlation_peak(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("other", F.col("value") * F.col("value"))
    return rounded(signal.correlation_peak(signal.lag_correlation(e, "value", "other", LAGS)))


CORRELATION_PEAK = f"""
WITH {EVENTS}, {_CURVE}, p AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY r DESC, lag) AS o FROM k)
SELECT recording_id, lag, round(r, 6) AS r FROM p WHERE o = 1
"""

FACTORS = [1, 2, 4, 8, 16]


def allan_deviation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signal.allan_deviation(events(spark, d), 0.01, FACTORS))


_ALLAN = """i AS (SELECT recording_id, row_number() OVER w AS i, sum(value) OVER w * 0.01 AS x FROM ev WINDOW w AS (PARTITION BY recording_id ORDER BY t_us, seq)),
p AS (SELECT recording_id, i, x FROM i UNION ALL SELECT DISTINCT recording_id, 0, 0.0 FROM i),
al AS (SELECT a.recording_id, f.m, f.m * 0.01 AS tau, count(*) AS pairs, sqrt(sum((c.x - 2 * b.x + a.x) ** 2) / (2 * (f.m * 0.01) ** 2 * count(*))) AS adev
  FROM (SELECT unnest([1, 2, 4, 8, 16]) AS m) f, p a JOIN p b ON a.recording_id = b.recording_id AND b.i = a.i + f.m JOIN p c ON a.recording_id = c.recording_id AND c.i = a.i + 2 * f.m GROUP BY 1, 2)"""
ALLAN_DEVIATION = f"WITH {EVENTS}, {_ALLAN} SELECT recording_id, CAST(m AS BIGINT) AS m, round(tau, 6) AS tau_s, pairs, round(adev, 6) AS adev FROM al"


def bias_instability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signal.bias_instability(signal.allan_deviation(events(spark, d), 0.01, FACTORS)))


BIAS_INSTABILITY = f"""
WITH {EVENTS}, {_ALLAN}, o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY adev, tau) AS k FROM al)
SELECT recording_id, round(adev / sqrt(2 * ln(2) / 3.141592653589793), 6) AS bias_instability, round(tau, 6) AS tau_s FROM o WHERE k = 1
"""


def asymptote_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signal.asymptote(signal.allan_deviation(events(spark, d), 0.01, FACTORS), -0.5, 1.0))


ASYMPTOTE_FIT = f"WITH {EVENTS}, {_ALLAN} SELECT recording_id, round(exp(avg(ln(adev) + 0.5 * ln(tau))), 6) AS coefficient, count(*) AS taus FROM al WHERE adev > 0 GROUP BY 1"


def weighted_scale(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("w", 1 / (1 + F.col("l_discount")))
    return rounded(signal.scale_through_origin(li, ["l_suppkey"], "l_quantity", "l_extendedprice", "w"))


WEIGHTED_SCALE = """
WITH w AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice AS y, 1 / (1 + l_discount) AS w FROM lineitem),
g AS (SELECT l_suppkey, count(*) AS n, sum(w * x * x) AS xx, sum(w * x * y) AS xy, sum(w * y * y) AS yy, sum(w) AS sw FROM w GROUP BY 1),
r AS (SELECT *, xy / xx AS k, greatest(yy - xy / xx * xy, 0.0) AS rest FROM g WHERE n > 1)
SELECT l_suppkey, n, round(k, 6) AS scale, round(sqrt(greatest(rest / (n - 1), 1.0)) / sqrt(xx), 6) AS sigma, round(sqrt(rest / sw), 6) AS weighted_rms FROM r
"""


def robust_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signal.robust_spread(events(spark, d), ["recording_id"], "value"))


ROBUST_SPREAD = f"""
WITH {EVENTS}, m AS (SELECT recording_id, median(value) AS med FROM ev GROUP BY 1)
SELECT recording_id, round(first(med), 6) AS median, round(1.4826 * median(abs(value - med)), 6) AS mad_sigma FROM ev JOIN m USING (recording_id) GROUP BY 1
"""


def clock_fit(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("x", F.col("seq") / 1000.0)
    return rounded(signal.line_fit(e, ["recording_id"], "x", "value"))


CLOCK_FIT = f"""
WITH {EVENTS}, e AS (SELECT recording_id, seq / 1000.0 AS x, value AS y FROM ev)
SELECT recording_id, count(*) AS n, round(regr_intercept(y, x), 6) AS a, round(regr_slope(y, x), 6) AS b FROM e GROUP BY 1
"""


def min_max_thinned(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.min_max_thinned(events(spark, d), 20).select("recording_id", "t_us", "seq", "value", "bucket"))


MIN_MAX_THINNED = f"""
WITH {EVENTS}, b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY recording_id ORDER BY t_us, seq) - 1) * 10 / count(*) OVER (PARTITION BY recording_id)) AS BIGINT) AS bucket FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, bucket ORDER BY value, t_us, seq) AS lo, row_number() OVER (PARTITION BY recording_id, bucket ORDER BY value DESC, t_us, seq) AS hi FROM b)
SELECT recording_id, t_us, seq, round(value, 6) AS value, bucket FROM r WHERE lo = 1 OR hi = 1
"""


def first_per_period(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.first_per_period(events(spark, d), 86_400_000_000).select("recording_id", "period", "t_us", "value"))


FIRST_PER_PERIOD = f"""
WITH {EVENTS}, p AS (SELECT *, CAST(floor((t_us - min(t_us) OVER (PARTITION BY recording_id)) / 86400000000) AS BIGINT) AS period FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY recording_id, period ORDER BY t_us, seq) AS k FROM p)
SELECT recording_id, period, t_us, round(value, 6) AS value FROM r WHERE k = 1
"""


def offset_filter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(filters.offset_filter(events(spark, d), 1e-4, 25.0, 10.0))


OFFSET_FILTER = f"""
WITH RECURSIVE {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_us, seq) AS i FROM ev),
k AS (
  SELECT recording_id, i, t_us, seq, value AS o, CAST(25.0 AS DOUBLE) AS p FROM r WHERE i = 1
  UNION ALL
  SELECT recording_id, i, t_us, seq, o + p1 / (p1 + rr) * dz, p1 * (1 - p1 / (p1 + rr)) FROM (
    SELECT *, CASE WHEN dz * dz > 10 * (p1 + 25.0) THEN dz * dz / 10 - p1 ELSE 25.0 END AS rr FROM (
      SELECT r.recording_id, r.i, r.t_us, r.seq, k.o, r.value - k.o AS dz, k.p + 1e-4 * (r.t_us - k.t_us) / 1e6 AS p1 FROM k JOIN r ON r.recording_id = k.recording_id AND r.i = k.i + 1))
)
SELECT recording_id, t_us, seq, round(o, 6) AS estimate FROM k
"""


def greedy_thinned(spark: SparkSession, d: str) -> DataFrame:
    return rounded(filters.greedy_thinned(events(spark, d), 86_400_000_000))


GREEDY_THINNED = f"""
WITH RECURSIVE {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t_us, seq) AS i FROM ev),
k AS (
  SELECT recording_id, i, t_us, seq, value, t_us AS last, true AS keep FROM r WHERE i = 1
  UNION ALL
  SELECT r.recording_id, r.i, r.t_us, r.seq, r.value, CASE WHEN r.t_us - k.last >= 86400000000 THEN r.t_us ELSE k.last END, r.t_us - k.last >= 86400000000
  FROM k JOIN r ON r.recording_id = k.recording_id AND r.i = k.i + 1
)
SELECT recording_id, t_us, seq, round(value, 6) AS value FROM k WHERE keep
"""


def tumbling_variance(spark: SparkSession, d: str) -> DataFrame:
    return filters.tumbling_variance(events(spark, d), 86_400_000_000).withColumn("variance", F.round("variance", 3))


def vertical_filter(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumns({"acc": (F.col("value") - 50) * 1e-9, "height": F.when(F.col("stream") == "view", F.col("value"))})
    # Heights here run up to 10^7 with hours between rows: six digits after the point would be past what a double holds.
    out = rounded(filters.vertical_filter(e, "acc", "height").withColumn("h", F.round("h", 3)))
    return out.withColumns({c: F.col(c) + 0.0 for c in ("h", "v", "bias")})  # no negative zeros


def vertical_smoother(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumns({"acc": (F.col("value") - 50) * 1e-9, "height": F.when(F.col("stream") == "view", F.col("value"))})
    return rounded(filters.vertical_filter(e, "acc", "height", smooth=True))


TUMBLING_VARIANCE = f"""
WITH RECURSIVE {EVENTS}, r AS (SELECT recording_id, t_us, value, row_number() OVER (PARTITION BY recording_id ORDER BY t_us, seq) AS i FROM ev),
k AS (
  SELECT recording_id, i, t_us AS t0, t_us AS t1, CAST(1 AS BIGINT) AS n, value AS s, value * value AS q, false AS done FROM r WHERE i = 1
  UNION ALL
  SELECT recording_id, i, t0, t_us, n, s, q, n >= 8 AND t_us - t0 >= 86400000000 FROM (
    SELECT r.recording_id, r.i, r.t_us, CASE WHEN k.done THEN r.t_us ELSE k.t0 END AS t0, CASE WHEN k.done THEN 1 ELSE k.n + 1 END AS n,
      r.value + CASE WHEN k.done THEN 0 ELSE k.s END AS s, r.value * r.value + CASE WHEN k.done THEN 0 ELSE k.q END AS q FROM k JOIN r ON r.recording_id = k.recording_id AND r.i = k.i + 1)
)
SELECT recording_id, t0 AS t0_us, t1 AS t1_us, n, round((q - s * s / n) / (n - 1), 3) AS variance FROM k WHERE done
"""


VERTICAL_FILTER = f"""
WITH RECURSIVE {EVENTS}, r AS (SELECT recording_id, t_us, seq, (value - 50) * 1e-9 AS a, CASE WHEN stream = 'view' THEN value END AS z, row_number() OVER (PARTITION BY recording_id ORDER BY t_us, seq) AS i FROM ev),
k AS (
  SELECT recording_id, CAST(0 AS BIGINT) AS i, t_us, seq, 0.0::DOUBLE AS h, 0.0::DOUBLE AS v, 0.0::DOUBLE AS b, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 0.0::DOUBLE AS p13, 1.0::DOUBLE AS p22, 0.0::DOUBLE AS p23, 0.01::DOUBLE AS p33 FROM r WHERE i = 1
  UNION ALL
  SELECT recording_id, i, t_us, seq, h + coalesce(n11 / (n11 + noise) * d, 0), v + coalesce(n12 / (n11 + noise) * d, 0), b + coalesce(n13 / (n11 + noise) * d, 0),
    coalesce(n11 * noise / (n11 + noise), n11), coalesce(n12 * noise / (n11 + noise), n12), coalesce(n13 * noise / (n11 + noise), n13),
    n22 - coalesce(n12 * n12 / (n11 + noise), 0), n23 - coalesce(n12 * n13 / (n11 + noise), 0), n33 - coalesce(n13 * n13 / (n11 + noise), 0)
  FROM (
    SELECT *, CASE WHEN d * d > 10 * (n11 + 1) THEN d * d / 10 - n11 WHEN d IS NOT NULL THEN 1 END AS noise FROM (
      SELECT recording_id, i, t_us, seq, h + v * dt + (a + b) * dt * dt / 2 AS h, v + (a + b) * dt AS v, b, z - (h + v * dt + (a + b) * dt * dt / 2) AS d,
        c1 + dt * c2 + dt * dt / 2 * c3 AS n11, c2 + dt * c3 AS n12, c3 AS n13, p22 + dt * p23 + dt * (p23 + dt * p33) + 1e-2 * dt AS n22, p23 + dt * p33 AS n23, p33 + 1e-6 * dt AS n33
      FROM (
        SELECT *, p11 + dt * p12 + dt * dt / 2 * p13 AS c1, p12 + dt * p22 + dt * dt / 2 * p23 AS c2, p13 + dt * p23 + dt * dt / 2 * p33 AS c3 FROM (
          SELECT r.recording_id, r.i, r.t_us, r.seq, r.a, r.z, CASE WHEN k.i = 0 THEN 0 ELSE greatest(r.t_us - k.t_us, 0) / 1e6 END AS dt, k.h, k.v, k.b, k.p11, k.p12, k.p13, k.p22, k.p23, k.p33
          FROM k JOIN r ON r.recording_id = k.recording_id AND r.i = k.i + 1)
      )
    )
  )
)
SELECT recording_id, t_us, seq, round(h, 3) + 0e0 AS h, round(v, 6) + 0e0 AS v, round(b, 6) + 0e0 AS bias FROM k WHERE i > 0
"""


def doctor_findings(spark: SparkSession, d: str) -> DataFrame:
    m = gap_statistics(spark, d)
    rules = [("few_samples", 2, F.col("n") < 50), ("long_gap", 2, F.col("max_gap_s") > 3 * 86400), ("late_gap", 1, F.col("max_gap_at_s") > 0.8 * F.col("duration_s")), ("low_rate", 0, F.col("avg_hz") < 3.2e-5)]
    return gates.findings(m, ["recording_id"], rules)


DOCTOR_FINDINGS = f"""
WITH m AS ({GAP_STATISTICS})
SELECT recording_id, 'few_samples' AS rule, 2 AS severity FROM m WHERE n < 50
UNION ALL SELECT recording_id, 'long_gap', 2 FROM m WHERE max_gap_s > 259200
UNION ALL SELECT recording_id, 'late_gap', 1 FROM m WHERE max_gap_at_s > 0.8 * duration_s
UNION ALL SELECT recording_id, 'low_rate', 0 FROM m WHERE avg_hz < 3.2e-5
"""

#: Queries that SQL expresses, by name in capitals above; the others are tested against loops.
WITH_SQL = (
    gap_statistics, bucketed_rate, difference_noise, newest_only_attach, asof_backward, nearest_join, interpolated_join, fifo_capacity, outage_cut, coast_gaps, session_split, block_decimate,
    rolling_variance, static_intervals, state_spans, restart_segments, unwrapped_angle, score_statistics, order_statistics, pooled_phase_std, quality_shares, start_mean, lag_correlation, correlation_peak,
    allan_deviation, bias_instability, asymptote_fit, weighted_scale, robust_spread, clock_fit, min_max_thinned, first_per_period, offset_filter, greedy_thinned, tumbling_variance, vertical_filter, doctor_findings,
)
WITHOUT_SQL = (vertical_smoother,)
