"""Queries on noise, stillness and findings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import doctor, noise, signal
from driftline.plans.streams import EVENTS, rounded
from driftline.sources.streams import events

FACTORS = [1, 2, 3, 4, 5, 6, 8, 10, 12, 16]


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return signal.allan_deviation(events(spark, d), 0.5, FACTORS).select("recording_id", "tau_s", "adev")


def _durations(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("recording_id").agg((F.count(F.lit(1)) * 0.5).alias("duration_s"))


_CURVE = f"""{EVENTS}, i AS (SELECT recording_id, row_number() OVER w AS i, sum(value) OVER w * 0.5 AS x FROM ev WINDOW w AS (PARTITION BY recording_id ORDER BY t_us, seq)),
p AS (SELECT recording_id, i, x FROM i UNION ALL SELECT DISTINCT recording_id, 0, 0.0 FROM i),
al AS (SELECT a.recording_id, f.m * 0.5e0 AS tau, sqrt(sum((c.x - 2 * b.x + a.x) ** 2) / (2 * (f.m * 0.5) ** 2 * count(*))) AS adev
  FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 8, 10, 12, 16]) AS m) f, p a JOIN p b ON a.recording_id = b.recording_id AND b.i = a.i + f.m JOIN p c ON a.recording_id = c.recording_id AND c.i = a.i + 2 * f.m GROUP BY a.recording_id, f.m),
du AS (SELECT recording_id, count(*) * 0.5e0 AS duration_s FROM ev GROUP BY 1)"""
# The derivative of the parabola through three neighbouring points, at the middle one.
_SLOPES = f"""{_CURVE}, lg AS (SELECT *, ln(tau) AS x1, ln(adev) AS y1, lag(ln(tau)) OVER w AS x0, lag(ln(adev)) OVER w AS y0, lead(ln(tau)) OVER w AS x2, lead(ln(adev)) OVER w AS y2
  FROM al WHERE adev > 0 WINDOW w AS (PARTITION BY recording_id ORDER BY tau)),
sl AS (SELECT recording_id, tau, adev, CASE WHEN x0 IS NULL THEN (y2 - y1) / (x2 - x1) WHEN x2 IS NULL THEN (y1 - y0) / (x1 - x0)
  ELSE y0 * (x1 - x2) / ((x0 - x1) * (x0 - x2)) + y1 * (2 * x1 - x0 - x2) / ((x1 - x0) * (x1 - x2)) + y2 * (x1 - x0) / ((x2 - x0) * (x2 - x1)) END AS slope FROM lg)"""


def allan_slopes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(noise.local_slope(_curve(spark, d).where("adev > 0")))


ALLAN_SLOPES = f"WITH {_SLOPES} SELECT recording_id, round(tau, 6) AS tau_s, round(adev, 6) AS adev, round(slope, 6) AS slope FROM sl"


def axis_analysis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(noise.axis_analysis(_curve(spark, d), _durations(spark, d)))


AXIS_ANALYSIS = f"""
WITH {_SLOPES}, n AS (SELECT recording_id FROM sl GROUP BY 1 HAVING count(*) >= 3),
a AS (SELECT sl.*, tau <= duration_s / 10 AS few, max(CASE WHEN tau <= duration_s / 10 THEN 1 ELSE 0 END) OVER (PARTITION BY sl.recording_id) AS any_few FROM sl JOIN du USING (recording_id) JOIN n USING (recording_id)),
b AS (SELECT *, few OR any_few = 0 AS sure FROM a),
f AS (SELECT recording_id, tau AS at_tau FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY adev, tau) AS k FROM b WHERE sure) WHERE k = 1),
c AS (SELECT b.*, at_tau FROM b JOIN f USING (recording_id)),
wf AS (SELECT recording_id, exp(avg(ln(adev * sqrt(tau)))) AS v FROM c WHERE tau <= at_tau AND slope BETWEEN -0.75 AND -0.25 GROUP BY 1 HAVING count(*) >= 3),
wb AS (SELECT recording_id, min(adev * sqrt(tau)) AS v FROM c WHERE tau <= at_tau GROUP BY 1),
kf AS (SELECT recording_id, exp(avg(ln(adev / sqrt(tau / 3)))) AS v FROM c WHERE sure AND tau >= at_tau AND slope BETWEEN 0.25 AND 0.75 GROUP BY 1 HAVING count(*) >= 3),
kb AS (SELECT recording_id, min(adev / sqrt(tau / 3)) AS v FROM c WHERE sure GROUP BY 1),
rs AS (SELECT recording_id, min(tau) AS v FROM c WHERE tau >= at_tau AND slope >= 0.25 GROUP BY 1)
SELECT du.recording_id, round(coalesce(wf.v, wb.v), 6) AS white_noise, round(coalesce(kf.v, kb.v), 6) AS random_walk, kf.v IS NOT NULL AS resolved, round(rs.v, 6) AS rise_s
FROM du LEFT JOIN wf USING (recording_id) LEFT JOIN wb USING (recording_id) LEFT JOIN kf USING (recording_id) LEFT JOIN kb USING (recording_id) LEFT JOIN rs USING (recording_id)
"""


def bias_floor(spark: SparkSession, d: str) -> DataFrame:
    return rounded(noise.bias_floor(_curve(spark, d), F.lit(5.0)))


BIAS_FLOOR = f"""
WITH {_CURVE}, o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY adev, tau) AS k, max(tau) OVER (PARTITION BY recording_id) AS top FROM al WHERE tau <= 5 AND adev > 0)
SELECT recording_id, round(adev / sqrt(2 * ln(2) / 3.141592653589793), 6) AS bias_instability, round(tau, 6) AS tau_s, tau <> top AS resolved FROM o WHERE k = 1
"""


def imu_grades(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    dph = [F.pow(F.lit(10.0), (F.col("p_partkey") * k % 50) / 10.0 - 3) for k in (3, 5, 7)]
    worst = F.radians(F.greatest(*dph)) / 3600
    return p.select("p_partkey", noise.grade(worst).alias("grade"), noise.implausible(worst, 4.8481e-8, 4.8481e-3).alias("implausible"), noise.axes_disagree(dph).alias("disagree"))


IMU_GRADES = """
WITH v AS (SELECT p_partkey, pow(10.0, (p_partkey * 3 % 50) / 10.0 - 3) AS a, pow(10.0, (p_partkey * 5 % 50) / 10.0 - 3) AS b, pow(10.0, (p_partkey * 7 % 50) / 10.0 - 3) AS c FROM part),
w AS (SELECT *, degrees(radians(greatest(a, b, c)) / 3600) * 3600 AS g FROM v)
SELECT p_partkey, CASE WHEN g < 0.01 THEN 'navigation grade' WHEN g < 0.1 THEN 'high-end tactical grade' WHEN g < 1 THEN 'tactical grade' WHEN g < 10 THEN 'industrial MEMS' ELSE 'consumer MEMS' END AS grade,
  NOT radians(greatest(a, b, c)) / 3600 BETWEEN 4.8481e-8 AND 4.8481e-3 AS implausible, greatest(a, b, c) / least(a, b, c) > 3 AS disagree FROM w
"""


def _axes(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumns({"x": F.col("value"), "y": F.col("value") * 0.5 + F.col("seq") % 17, "z": (F.col("seq") % 101).cast("double")})


_AXES = f"""{EVENTS}, ax AS (SELECT *, value AS x, value * 0.5 + seq % 17 AS y, CAST(seq % 101 AS DOUBLE) AS z, row_number() OVER (PARTITION BY recording_id ORDER BY t_us, seq) - 1 AS i, count(*) OVER (PARTITION BY recording_id) AS n FROM ev),
wd AS (SELECT *, CAST(i // 5 AS BIGINT) AS "window" FROM ax WHERE n // 5 >= 2 AND i < n // 5 * 5)"""


def window_peaks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(noise.window_peaks(_axes(spark, d), 5, ["x", "y", "z"]))


_PEAKS = f"""{_AXES}, md AS (SELECT recording_id, median(x) AS mx, median(y) AS my, median(z) AS mz FROM wd GROUP BY 1),
pk AS (SELECT recording_id, "window", max(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)) AS peak FROM wd JOIN md USING (recording_id) GROUP BY 1, 2)"""
WINDOW_PEAKS = f'WITH {_PEAKS} SELECT recording_id, "window", round(peak, 6) AS peak FROM pk'


def motion_segments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(noise.motion_segments(noise.window_peaks(_axes(spark, d), 5, ["x", "y", "z"]), 100.0))


MOTION_SEGMENTS = f"""
WITH {_PEAKS}, o AS (SELECT *, peak > 100 AND NOT coalesce(lag(peak > 100) OVER w, false) AS starts FROM pk WINDOW w AS (PARTITION BY recording_id ORDER BY "window")),
s AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY "window") AS k FROM o)
SELECT recording_id, min("window") AS "first", max("window") AS "last", round(max(peak), 6) AS peak FROM s WHERE peak > 100 GROUP BY recording_id, k
"""


def window_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(noise.window_means(_axes(spark, d), 5, ["x", "y", "z"]))


WINDOW_MEANS = f'WITH {_AXES} SELECT recording_id, "window", round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM wd GROUP BY 1, 2'


def standstill_accuracy(spark: SparkSession, d: str) -> DataFrame:
    e = _axes(spark, d).withColumns({"y": F.when(F.col("seq") % 4 > 0, F.col("y")), "sigma": F.when(F.col("seq") % 3 > 0, 20.0 + F.col("seq") % 10)})
    return rounded(noise.standstill_accuracy(e, ["recording_id"], ["stream"], {"hor": (["x", "y"], "sigma"), "ver": (["z"], None)}))


STANDSTILL_ACCURACY = f"""
WITH {EVENTS}, e AS (SELECT *, value AS x, CASE WHEN seq % 4 > 0 THEN value * 0.5 + seq % 17 END AS y, CAST(seq % 101 AS DOUBLE) AS z, CASE WHEN seq % 3 > 0 THEN 20.0 + seq % 10 END AS sigma, count(*) OVER (PARTITION BY recording_id, stream) AS n FROM ev),
u AS (SELECT * FROM e WHERE n >= 4),
lo AS (SELECT recording_id, stream, 'hor' AS g, 'x' AS a, x AS v FROM u UNION ALL SELECT recording_id, stream, 'hor', 'y', y FROM u UNION ALL SELECT recording_id, stream, 'ver', 'z', z FROM u),
dv AS (SELECT recording_id, g, v - avg(v) OVER (PARTITION BY recording_id, stream, g, a) AS dv, count(v) OVER (PARTITION BY recording_id, stream, g, a) AS c, row_number() OVER (PARTITION BY recording_id, stream, g, a ORDER BY v NULLS LAST) AS k FROM lo),
s AS (SELECT recording_id, g, sqrt(sum(CASE WHEN c > 1 THEN dv * dv ELSE 0 END) / sum(CASE WHEN k = 1 AND c > 1 THEN c - 1 ELSE 0 END)) AS m FROM dv GROUP BY 1, 2),
r AS (SELECT recording_id, count(DISTINCT stream) AS phases, CAST(count(*) AS BIGINT) AS "rows", sqrt(avg(sigma * sigma)) AS rep FROM u GROUP BY 1)
SELECT r.recording_id, phases, "rows", round(h.m, 6) AS hor_measured, round(rep, 6) AS hor_reported, round(h.m / rep, 6) AS hor_ratio, round(v.m, 6) AS ver_measured, CAST(NULL AS DOUBLE) AS ver_reported, CAST(NULL AS DOUBLE) AS ver_ratio
FROM r JOIN s h ON h.recording_id = r.recording_id AND h.g = 'hor' JOIN s v ON v.recording_id = r.recording_id AND v.g = 'ver'
"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of one made-up recording for each customer; every rule holds for some."""
    k = F.col("c_custkey")
    m = lambda a, n, s: (k * a % n) * s
    some = lambda c, a: F.when(k % a > 0, c)
    return spark.read.parquet(f"{d}/customer.parquet").select(
        k.alias("k"), some(m(7, 100, 0.01), 6).alias("imu_max_gap"), m(11, 50, 0.1).alias("imu_max_gap_at"), m(13, 40, 0.01).alias("imu_rate_spread"), m(3, 5, 1).alias("gnss_n"), m(17, 30, 0.5).alias("gnss_max_gap"),
        some(m(19, 260, 10.0) - 100, 4).alias("latency_ms"), m(23, 20, 10.0).alias("delay_ms"), m(5, 4, 1).alias("jamming_bad"), some(m(29, 3, 1), 5).alias("spoofing_bad"),
        m(31, 300, 0.5).alias("gyr_noise_ratio"), (k % 9 == 0).alias("gyr_band_limited"), some(m(37, 90, 0.0005) - 0.02, 7).alias("gravity_dev"), m(41, 150, 0.1).alias("pos_hor_ratio"), m(43, 100, 0.01).alias("vel_ver_ratio"),
        m(47, 80, 0.01).alias("gnss_hor_mps"), m(2, 5, 0.1).alias("gnss_max_hor_mps"), m(53, 40, 0.05).alias("baro_ratio"), m(59, 3, 1).alias("roll_exceeded"), m(61, 2, 1).alias("pitch_exceeded"), m(67, 4, 1).alias("yaw_exceeded"),
        m(71, 3, 1).alias("pos_exceeded"), (k % 50 == 0).alias("overconfident"), m(73, 100, 1).alias("fixes_seen"), (m(73, 100, 1) * 0.7).cast("long").alias("fixes_used"), m(3, 10, 1).alias("fixes_rejected"), m(5, 20, 1).alias("downweighted"),
        F.when(k % 3 == 0, "score_unset").when(k % 3 == 1, "differ").otherwise("same").alias("lever_arms"), m(79, 30, 0.7).alias("baro_offset_span"),
        F.when(k % 2 == 0, "gnss").otherwise("none").alias("aiding_mode"), (k % 3 * 4.0).alias("satellites"), F.col("c_custkey").alias("least_satellites"),
    )


_METRICS = """m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 6 > 0 THEN (c_custkey * 7 % 100) * 0.01 END AS gap, (c_custkey * 11 % 50) * 0.1 AS gap_at, (c_custkey * 13 % 40) * 0.01 AS spread, c_custkey * 3 % 5 AS gn, (c_custkey * 17 % 30) * 0.5 AS ggap,
  CASE WHEN c_custkey % 4 > 0 THEN (c_custkey * 19 % 260) * 10.0 - 100 END AS lat, (c_custkey * 23 % 20) * 10.0 AS delay, c_custkey * 5 % 4 AS jam, CASE WHEN c_custkey % 5 > 0 THEN c_custkey * 29 % 3 END AS spoof,
  (c_custkey * 31 % 300) * 0.5 AS gyr, c_custkey % 9 = 0 AS bl, CASE WHEN c_custkey % 7 > 0 THEN CAST((c_custkey * 37 % 90) AS DOUBLE) * 0.0005e0 - 0.02e0 END AS dev, CAST(c_custkey * 41 % 150 AS DOUBLE) * 0.1e0 AS ph, CAST(c_custkey * 43 % 100 AS DOUBLE) * 0.01e0 AS vv,
  CAST(c_custkey * 47 % 80 AS DOUBLE) * 0.01e0 AS hv, CAST(c_custkey * 2 % 5 AS DOUBLE) * 0.1e0 AS lim, CAST(c_custkey * 53 % 40 AS DOUBLE) * 0.05e0 AS baro, c_custkey * 59 % 3 AS ro, c_custkey * 61 % 2 AS pi, c_custkey * 67 % 4 AS ya, c_custkey * 71 % 3 AS po,
  c_custkey * 73 % 100 AS seen, CAST(floor((c_custkey * 73 % 100) * 0.7) AS BIGINT) AS used, c_custkey * 3 % 10 AS rej, c_custkey * 5 % 20 AS down, CAST(c_custkey * 79 % 30 AS DOUBLE) * 0.7e0 AS span FROM customer),
g AS (
  SELECT k, CASE WHEN gap >= 0.5 THEN CASE WHEN gap_at - gap < 2 THEN '2imu_late_start' ELSE '2imu_dropout' END WHEN gap >= 0.1 THEN '1imu_minor_dropout' WHEN gap IS NOT NULL THEN '0imu_continuous' END AS r FROM m
  UNION ALL SELECT k, CASE WHEN spread > 0.25 THEN '2imu_rate_varies' WHEN spread > 0.05 THEN '1imu_rate_wobbles' END FROM m
  UNION ALL SELECT k, CASE WHEN gn < 2 THEN CASE WHEN k % 2 = 0 THEN '1gnss_few_fixes' END WHEN ggap >= 10 THEN '3gnss_outage' WHEN ggap >= 2 THEN '2gnss_gap' ELSE '0gnss_coverage' END FROM m
  UNION ALL SELECT k, CASE WHEN lat < -50 OR lat > 2000 THEN '2latency_implausible' WHEN lat - delay > 20 THEN '2delay_below_latency' ELSE '0latency_covered' END FROM m WHERE lat IS NOT NULL
  UNION ALL SELECT k, '1satellites' FROM m WHERE k % 3 > 0
  UNION ALL SELECT k, CASE jam WHEN 0 THEN '0no_jamming' ELSE '2jamming' END FROM m
  UNION ALL SELECT k, CASE spoof WHEN 0 THEN '0no_spoofing' ELSE '2spoofing' END FROM m WHERE spoof IS NOT NULL
  UNION ALL SELECT k, CASE WHEN bl THEN '1gyro_band_limited' WHEN gyr > 100 THEN '2gyro_noise_optimistic' WHEN gyr < 1 THEN '0gyro_noise_conservative' ELSE '0gyro_noise' END FROM m
  UNION ALL SELECT k, CASE WHEN abs(dev) > 0.02 THEN '2accel_scale' WHEN abs(dev) > 0.01 THEN '1accel_slightly_off' ELSE '0accel_gravity' END FROM m WHERE dev IS NOT NULL
  UNION ALL SELECT k, '2gnss_sigma_optimistic' FROM m WHERE ph > 10 OR vv > 10
  UNION ALL SELECT k, '1gnss_sigma_pessimistic' FROM m WHERE ph < 0.1 OR vv < 0.1
  UNION ALL SELECT k, '0gnss_sigma' FROM m WHERE ph BETWEEN 0.1 AND 10 AND vv BETWEEN 0.1 AND 10
  UNION ALL SELECT k, CASE WHEN hv > 0.5 OR (lim > 0 AND hv > lim) THEN '2gnss_velocity_weak' ELSE '0gnss_velocity' END FROM m
  UNION ALL SELECT k, CASE WHEN baro > 1.3 THEN '2baro_optimistic' WHEN baro < 0.77 THEN '1baro_pessimistic' ELSE '0baro_sigma' END FROM m
  UNION ALL SELECT k, '2levelling_uncertain' FROM m WHERE ro > 0 OR pi > 0
  UNION ALL SELECT k, '2yaw_uncertain' FROM m WHERE ya > 0
  UNION ALL SELECT k, '2position_uncertain' FROM m WHERE po > 0
  UNION ALL SELECT k, '0uncertainty_bounded' FROM m WHERE ro = 0 AND pi = 0 AND ya = 0 AND po = 0
  UNION ALL SELECT k, '3covariance_collapse' FROM m WHERE k % 50 = 0
  UNION ALL SELECT k, CASE WHEN rej * 5 > seen THEN '2fixes_rejected' WHEN (seen - used - rej) * 5 > seen THEN '1fixes_skipped' END FROM m WHERE seen > 0
  UNION ALL SELECT k, CASE k % 3 WHEN 0 THEN '2lever_arm_unset' WHEN 1 THEN '1lever_arms_differ' END FROM m WHERE seen > 0
  UNION ALL SELECT k, CASE WHEN span >= 10 THEN '2baro_height_drift' ELSE '0baro_height' END FROM m WHERE seen > 0
  UNION ALL SELECT k, '1downweighted' FROM m WHERE used > 0 AND down * 20 > used * 3
), q AS (SELECT k, substr(r, 2) AS rule, CAST(substr(r, 1, 1) AS INT) AS severity FROM g WHERE r IS NOT NULL)"""


def doctor_report(spark: SparkSession, d: str) -> DataFrame:
    return doctor.report(_metrics(spark, d), ["k"])


DOCTOR_REPORT = f"WITH {_METRICS} SELECT k, rule, severity FROM q"


def doctor_summary(spark: SparkSession, d: str) -> DataFrame:
    return doctor.summary(doctor.report(_metrics(spark, d), ["k"]), ["k"])


DOCTOR_SUMMARY = f"""
WITH {_METRICS} SELECT k, count(*) FILTER (severity = 3) AS critical, count(*) FILTER (severity = 2) AS warnings, count(*) FILTER (severity = 1) AS information, max(severity) AS worst FROM q GROUP BY k
"""

WITH_SQL = (allan_slopes, axis_analysis, bias_floor, imu_grades, window_peaks, motion_segments, window_means, standstill_accuracy, doctor_report, doctor_summary)
WITHOUT_SQL = ()
