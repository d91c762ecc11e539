"""Queries that evaluate the scalar library on positions and angles made from keys, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import atmosphere, covariance, geo, rotation
from driftline.operators import calibration, gates, quality
from driftline.plans.streams import rounded
from driftline.sources import frames

PI = "3.141592653589793"
#: A point for each customer: latitude and longitude in degrees, height in m.
POINTS = "pt AS (SELECT c_custkey AS k, (c_custkey * 37 % 1600) / 10.0 - 80 AS lat_deg, (c_custkey * 53 % 3600) / 10.0 - 180 AS lon_deg, c_acctbal / 10.0 AS h, radians((c_custkey * 37 % 1600) / 10.0 - 80) AS lat, radians((c_custkey * 53 % 3600) / 10.0 - 180) AS lon FROM customer)"
#: Roll, pitch and yaw in radians for each customer.
ANGLES = "an AS (SELECT c_custkey AS k, (c_custkey * 7 % 600) / 100.0 - 3 AS roll, (c_custkey * 11 % 280) / 100.0 - 1.4 AS pitch, (c_custkey * 13 % 620) / 100.0 - 3.1 AS yaw FROM customer)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    lat, lon = (k * 37 % 1600) / 10.0 - 80, (k * 53 % 3600) / 10.0 - 180
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), lat.alias("lat_deg"), lon.alias("lon_deg"), (F.col("c_acctbal") / 10.0).alias("h"), F.radians(lat).alias("lat"), F.radians(lon).alias("lon"))


def _angles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), ((k * 7 % 600) / 100.0 - 3).alias("roll"), ((k * 11 % 280) / 100.0 - 1.4).alias("pitch"), ((k * 13 % 620) / 100.0 - 3.1).alias("yaw"))


def geodesy_ecef(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = geo.llh_to_ecef(F.col("lat"), F.col("lon"), F.col("h"))
    p = _points(spark, d).select("k", x.alias("x"), y.alias("y"), z.alias("z"))
    lat, lon, h = geo.ecef_to_llh(F.col("x"), F.col("y"), F.col("z"))
    out = p.select("k", "x", "y", "z", F.degrees(lat).alias("lat_deg"), F.degrees(lon).alias("lon_deg"), h.alias("h"))
    return out.select("k", *((F.round(c, 4) + 0.0).alias(c) for c in out.columns[1:]))


GEODESY_ECEF = f"""
WITH {POINTS}, n AS (SELECT *, 6378137.0 / sqrt(1 - 0.00669437999014 * sin(lat) ** 2) AS n FROM pt)
SELECT k, round((n + h) * cos(lat) * cos(lon), 4) + 0e0 AS x, round((n + h) * cos(lat) * sin(lon), 4) + 0e0 AS y, round((n * (1 - 0.00669437999014) + h) * sin(lat), 4) + 0e0 AS z,
  round(lat_deg, 4) + 0e0 AS lat_deg, round(lon_deg, 4) + 0e0 AS lon_deg, round(h, 4) + 0e0 AS h FROM n
"""


def geodesy_radii(spark: SparkSession, d: str) -> DataFrame:
    lat = F.col("lat")
    wn, we, wd = geo.navigation_rate(lat, F.col("h"), F.lit(10.0), F.lit(-5.0))
    return rounded(_points(spark, d).select("k", geo.meridian_radius(lat).alias("meridian"), geo.transverse_radius(lat).alias("transverse"), geo.normal_gravity(lat, F.col("h")).alias("gravity"), (wn * 1e6).alias("wn"), (we * 1e6).alias("we"), (wd * 1e6).alias("wd")))


GEODESY_RADII = f"""
WITH {POINTS}, r AS (SELECT *, sin(lat) ** 2 AS s, 6378137.0 * (1 - 0.00669437999014) / pow(1 - 0.00669437999014 * sin(lat) ** 2, 1.5) AS m, 6378137.0 / sqrt(1 - 0.00669437999014 * sin(lat) ** 2) AS n FROM pt)
SELECT k, round(m, 6) AS meridian, round(n, 6) AS transverse,
  round(9.7803253359 * (1 + 5.27904265e-3 * s + 2.32718e-5 * s * s + 1.26209e-7 * s * s * s) * (1 - 2 / 6378137.0 * (1 + 3.35281066475e-3 + 3.44978650684e-3 - 2 * 3.35281066475e-3 * s) * h + 3 / (6378137.0 * 6378137.0) * h * h), 6) AS gravity,
  round((7.292115e-5 * cos(lat) - 5.0 / (n + h)) * 1e6, 6) AS wn, round(-10.0 / (m + h) * 1e6, 6) AS we, round((-7.292115e-5 * sin(lat) + 5.0 / (n + h) * tan(lat)) * 1e6, 6) AS wd FROM r
"""


def geodesy_distance(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    m = geo.haversine(F.col("lat"), F.col("lon"), F.radians(F.lit(48.0)), F.radians(F.lit(11.0)))
    dn, de, dd = geo.dned_to_dllh(F.lit(100.0), F.lit(-50.0), F.lit(2.0), F.col("lat"), F.col("h"))
    bn, be, _ = geo.dllh_to_dned(dn, de, dd, F.col("lat"), F.col("h"))
    return rounded(p.select("k", m.alias("metres"), F.degrees(dn).alias("dlat_deg"), F.degrees(de).alias("dlon_deg"), bn.alias("north"), be.alias("east")))


GEODESY_DISTANCE = f"""
WITH {POINTS}, r AS (SELECT *, 6378137.0 * (1 - 0.00669437999014) / pow(1 - 0.00669437999014 * sin(lat) ** 2, 1.5) AS m, 6378137.0 / sqrt(1 - 0.00669437999014 * sin(lat) ** 2) AS n FROM pt)
SELECT k, round(2 * 6378137.0 * asin(least(1.0, sqrt(sin((radians(48.0) - lat) / 2) ** 2 + cos(lat) * cos(radians(48.0)) * sin((radians(11.0) - lon) / 2) ** 2))), 6) AS metres,
  round(degrees(100.0 / (m + h)), 6) AS dlat_deg, round(degrees(-50.0 / ((n + h) * cos(lat))), 6) AS dlon_deg, 100.0 AS north, -50.0 AS east FROM r
"""


def map_tiles(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.tile(F.col("lat_deg"), F.col("lon_deg"), 12)
    return rounded(_points(spark, d).select("k", x.alias("x"), y.alias("y"), geo.metres_per_pixel(F.col("lat_deg"), 12).alias("scale")))


MAP_TILES = f"""
WITH {POINTS} SELECT k, round((lon_deg + 180) / 360 * 4096, 6) AS x, round((1 - ln(tan(lat) + 1 / cos(lat)) / {PI}) / 2 * 4096, 6) AS y,
  round(cos(lat) * (2e0 * {PI} * 6378137e0 / 1048576), 6) AS scale FROM pt
"""


def isa_altitude(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 1.5).alias("p"))
    return rounded(p.select("l_orderkey", "l_linenumber", atmosphere.altitude(F.col("p")).alias("h"), atmosphere.plausible(F.col("p")).alias("plausible")))


ISA_ALTITUDE = """
SELECT l_orderkey, l_linenumber, round(44330.0 * (1 - pow(l_extendedprice * 1.5 / 101325.0, 1 / 5.255)), 6) AS h, l_extendedprice * 1.5 BETWEEN 10000 AND 120000 AS plausible FROM lineitem
"""


def attitude_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    q = rotation.from_rpy(F.col("roll"), F.col("pitch"), F.col("yaw"))
    a = _angles(spark, d).select("*", *(c.alias(n) for c, n in zip(q, "wxyz", strict=True)))
    roll, pitch, yaw = rotation.to_rpy(tuple(F.col(c) for c in "wxyz"))
    down = rotation.to_matrix(tuple(F.col(c) for c in "wxyz"))[2]
    return rounded(a.select("k", "w", "x", "y", "z", roll.alias("roll"), pitch.alias("pitch"), yaw.alias("yaw"), down[1].alias("r21"), down[2].alias("r22")))


ATTITUDE_ROUNDTRIP = f"""
WITH {ANGLES}, c AS (SELECT *, cos(roll / 2) AS cr, sin(roll / 2) AS sr, cos(pitch / 2) AS cp, sin(pitch / 2) AS sp, cos(yaw / 2) AS cy, sin(yaw / 2) AS sy FROM an)
SELECT k, round(cy * cp * cr + sy * sp * sr, 6) AS w, round(cy * cp * sr - sy * sp * cr, 6) AS x, round(cy * sp * cr + sy * cp * sr, 6) AS y, round(sy * cp * cr - cy * sp * sr, 6) AS z,
  round(roll, 6) AS roll, round(pitch, 6) AS pitch, round(yaw, 6) AS yaw, round(cos(pitch) * sin(roll), 6) AS r21, round(cos(pitch) * cos(roll), 6) AS r22 FROM c
"""


def attitude_rate(spark: SparkSession, d: str) -> DataFrame:
    """A turn about the body's down axis only moves the yaw of a level attitude."""
    a = _angles(spark, d)
    q = rotation.integrated(rotation.from_rpy(F.lit(0.0), F.lit(0.0), F.col("yaw")), (F.lit(0.0), F.lit(0.0), F.col("roll")), F.lit(0.5))
    return rounded(a.select("k", rotation.to_rpy(q)[2].alias("yaw"), rotation.angle_diff(F.col("yaw"), F.col("roll")).alias("diff"), geo.wrap_pi(F.col("yaw") * 3).alias("wrapped")))


ATTITUDE_RATE = f"""
WITH {ANGLES} SELECT k, round(atan2(sin(yaw + roll * 0.5), cos(yaw + roll * 0.5)), 6) AS yaw, round(atan2(sin(yaw - roll), cos(yaw - roll)), 6) AS diff, round(atan2(sin(yaw * 3), cos(yaw * 3)), 6) AS wrapped FROM an
"""


def levelling(spark: SparkSession, d: str) -> DataFrame:
    """Roll and pitch back from the gravity they cause, and the heading from a field that points north."""
    a = _angles(spark, d).withColumn("pitch", F.col("pitch") * 0.9)
    m = rotation.to_matrix(rotation.from_rpy(F.col("roll"), F.col("pitch"), F.col("yaw")))
    acc = tuple(-9.80665 * m[2][i] for i in range(3))
    field = tuple(20.0 * m[0][i] + 40.0 * m[2][i] for i in range(3))
    roll, pitch = rotation.levelled(acc)
    yaw = rotation.baseline_yaw(F.col("yaw"), F.lit(0.0), F.lit(0.0), (F.lit(1.0), F.lit(1.0), F.lit(0.0)))
    return rounded(a.select("k", roll.alias("roll"), pitch.alias("pitch"), rotation.magnetic_heading(field, F.col("roll"), F.col("pitch")).alias("heading"), yaw.alias("baseline_yaw")))


LEVELLING = f"""
WITH {ANGLES} SELECT k, round(roll, 6) AS roll, round(pitch * 0.9, 6) AS pitch, round(yaw, 6) AS heading, round(atan2(sin(yaw - {PI} / 4), cos(yaw - {PI} / 4)), 6) AS baseline_yaw FROM an
"""

#: A covariance for each customer.
COVS = "cv AS (SELECT c_custkey AS k, 1.0 + c_custkey % 7 AS nn, 0.1 * (c_custkey % 5) AS ne, 0.05 * (c_custkey % 3) AS nd, 2.0 + c_custkey % 4 AS ee, -0.1 * (c_custkey % 2) AS ed, 3.0 + c_custkey % 9 AS dd FROM customer)"


def _covs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), (1.0 + k % 7).alias("nn"), (0.1 * (k % 5)).alias("ne"), (0.05 * (k % 3)).alias("nd"), (2.0 + k % 4).alias("ee"), (-0.1 * (k % 2)).alias("ed"), (3.0 + k % 9).alias("dd"))


def covariance_conditioned(spark: SparkSession, d: str) -> DataFrame:
    names = ("nn", "ne", "nd", "ee", "ed", "dd")
    c = covariance.conditioned(tuple(map(F.col, names)), 1.5, 1.2, 2.0, 3.5)
    return rounded(_covs(spark, d).select("k", *(x.alias(n) for x, n in zip(c, names, strict=True))))


COVARIANCE_CONDITIONED = f"""
WITH {COVS}, s AS (SELECT k, greatest(nn * 2.25, 4.0) AS nn, ne * 2.25 AS ne, nd * 2.25 * 1.2 AS nd, greatest(ee * 2.25, 4.0) AS ee, ed * 2.25 * 1.2 AS ed, greatest(dd * 2.25 * 1.44, 4.0) AS dd FROM cv),
f AS (SELECT *, least(1.0, 3.5 / sqrt(nn)) AS kn, least(1.0, 3.5 / sqrt(ee)) AS ke, least(1.0, 3.5 / sqrt(dd)) AS kd FROM s)
SELECT k, round(nn * kn * kn, 6) AS nn, round(ne * kn * ke, 6) AS ne, round(nd * kn * kd, 6) AS nd, round(ee * ke * ke, 6) AS ee, round(ed * ke * kd, 6) AS ed, round(dd * kd * kd, 6) AS dd FROM f
"""


def error_ellipses(spark: SparkSession, d: str) -> DataFrame:
    a, b, t = geo.error_ellipse(F.col("nn"), F.col("ne"), F.col("ee"))
    roots = covariance.enu_roots(tuple(map(F.col, ("nn", "ne", "nd", "ee", "ed", "dd"))))
    return rounded(_covs(spark, d).select("k", a.alias("major"), b.alias("minor"), t.alias("angle"), *(r.alias(n) for r, n in zip(roots, ("e", "n", "u", "en", "nu", "ue"), strict=True))))


ERROR_ELLIPSES = f"""
WITH {COVS}, r AS (SELECT *, sqrt(((nn - ee) / 2) ** 2 + ne ** 2) AS root FROM cv)
SELECT k, round(sqrt(greatest((nn + ee) / 2 + root, 0)), 6) AS major, round(sqrt(greatest((nn + ee) / 2 - root, 0)), 6) AS minor, round(0.5 * atan2(2 * ne, nn - ee), 6) AS angle,
  round(sqrt(ee), 6) AS e, round(sqrt(nn), 6) AS n, round(sqrt(dd), 6) AS u, round(sign(ne) * sqrt(abs(ne)), 6) AS en, round(sign(-nd) * sqrt(abs(nd)), 6) AS nu, round(sign(-ed) * sqrt(abs(ed)), 6) AS ue FROM r
"""


def growth_rate(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    pos, vel = gates.growth_columns(F.col("p_size") * 1e-4, F.col("p_size") * 1e-6, F.col("p_retailprice") / 100)
    return rounded(p.select("p_partkey", pos.alias("pos_sigma"), vel.alias("vel_sigma")))


GROWTH_RATE = """
WITH p AS (SELECT p_partkey, p_size * 1e-4 AS a, p_size * 1e-6 AS w, p_retailprice / 100 AS t FROM part)
SELECT p_partkey, round(sqrt(a * t ** 3 / 3 + w * t ** 5 / 20), 6) AS pos_sigma, round(sqrt(a * t + w * t ** 3 / 3), 6) AS vel_sigma FROM p
"""


def gate_codes(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    reason = gates.heading_reason((k % 3).cast("int"), (k % 23) / 2.0, (k % 11) / 10.0)
    return o.select(
        "o_orderkey", reason.alias("heading_reason"), gates.mode(k % 2 == 0, k % 3 == 0, k % 4000).alias("mode"),
        gates.fix_quality(k % 6, k % 7 != 0, k % 2 == 1, k % 3).alias("quality"),
        gates.lever_arms([(k % 2).cast("double"), F.lit(0.0), F.lit(0.0)], [(k % 3).cast("double"), F.lit(0.0), F.lit(0.0)]).alias("lever_arms"),
    )


GATE_CODES = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN 'carrier' WHEN NOT ((o_orderkey % 23) / 2.0 > 0 AND (o_orderkey % 23) / 2.0 <= 10) THEN 'sigma' WHEN (o_orderkey % 11) / 10.0 < 0.1 THEN 'geometry' END AS heading_reason,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 4000 <= 2000 THEN 3 WHEN o_orderkey % 2 = 0 THEN 2 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS mode,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 6 NOT IN (2, 3, 4) THEN 0 WHEN o_orderkey % 3 = 2 THEN 1 WHEN o_orderkey % 3 = 1 THEN 2 WHEN o_orderkey % 2 = 1 THEN 4 ELSE 5 END AS quality,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'none' WHEN o_orderkey % 2 = o_orderkey % 3 THEN 'same' WHEN o_orderkey % 3 = 0 THEN 'score_unset' WHEN o_orderkey % 2 = 0 THEN 'gnss_unset' ELSE 'differ' END AS lever_arms FROM orders
"""


def fletcher_checksum(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    s = frames.fletcher(F.col("c_name").cast("binary"))
    return c.select("c_custkey", s.alias("s")).select("c_custkey", F.col("s.a").cast("long").alias("a"), F.col("s.b").cast("long").alias("b"))


FLETCHER_CHECKSUM = """
WITH n AS (SELECT c_custkey, c_name, unnest(range(1, length(c_name) + 1)) AS i FROM customer)
SELECT c_custkey, CAST(sum(ascii(c_name[i])) % 256 AS BIGINT) AS a, CAST(sum(ascii(c_name[i]) * (length(c_name) - i + 1)) % 256 AS BIGINT) AS b FROM n GROUP BY 1
"""


def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    terms = {n: F.col("embedding")[i].cast("double") for i, n in enumerate("abcd")}
    return rounded(calibration.gram(e, terms, ["label"]))


GRAM_MATRIX = "WITH e AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings) SELECT label, count(*) AS n, " + ", ".join(f"round(sum({x} * {y}), 6) AS {x}_{y}" for i, x in enumerate("abcd") for y in "abcd"[i:]) + " FROM e GROUP BY 1"


def fix_gates(spark: SparkSession, d: str) -> DataFrame:
    """Whether each epoch may be fused, counts for entry and is good enough to stay, with some covariances that are broken."""
    c = _covs(spark, d).withColumn("ee", F.when(F.col("k") % 13 == 0, -1.0).otherwise(F.col("ee")))
    names = ("nn", "ne", "nd", "ee", "ed", "dd")
    pos, vel = tuple(map(F.col, names)), tuple(F.col(n) / 100 for n in names)
    has_pos, has_vel = F.col("k") % 5 != 0, F.col("k") % 3 != 0
    limits = (2.0, 2.8, 0.21, 0.3)
    return c.select(
        "k", gates.usable(has_pos, pos, 2.2, 3.0).alias("fused"), gates.entry_quality(has_pos, pos, has_vel, vel, limits).alias("enters"),
        gates.stay_quality(has_pos, pos, has_vel, vel, limits).alias("stays"), gates.stay_quality(has_pos, pos, has_vel, vel, limits, F.col("k") % 17 == 0, True).alias("stays_by_baro"),
    )


FIX_GATES = f"""
WITH {COVS}, c AS (SELECT k, nn, CASE WHEN k % 13 = 0 THEN -1.0 ELSE ee END AS ee, dd, k % 5 <> 0 AS p, k % 3 <> 0 AS v FROM cv),
g AS (SELECT *, nn > 0 AND ee > 0 AND dd > 0 AS ok, nn / 100 <= 0.21 * 0.21 AND ee / 100 <= 0.21 * 0.21 AND dd / 100 <= 0.3 * 0.3 AS vel FROM c)
SELECT k, p AND ok AND nn <= 2.2 * 2.2 AND ee <= 2.2 * 2.2 AND dd <= 9 AS fused, p AND ok AND nn <= 4 AND ee <= 4 AND dd <= 2.8 * 2.8 AND (NOT v OR ok AND vel) AS enters,
  (NOT p OR ok AND nn <= 4 AND ee <= 4 AND dd <= 2.8 * 2.8) AND (NOT v OR ok AND vel) AS stays,
  k % 17 = 0 OR (NOT p OR ok AND nn <= 4 AND ee <= 4) AND (NOT v OR ok AND vel) AS stays_by_baro FROM g
"""


def truth_error(spark: SparkSession, d: str) -> DataFrame:
    """Error in ECEF of an estimate 3 m north, 4 m east of the truth, level, with a lever arm and a moving platform; and the truth from an origin."""
    p = _points(spark, d)
    dlat, dlon, dh = geo.dned_to_dllh(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.col("lat"), F.col("h"))
    est = geo.llh_to_ecef(F.col("lat") + dlat, F.col("lon") + dlon, F.col("h") + dh)
    one = lambda i, k: F.lit(1.0 if i == k else 0.0)
    err = geo.position_error(est, [[one(i, k) for k in range(3)] for i in range(3)], (F.lit(10.0), F.lit(0.0), F.lit(0.0)), (F.col("lat"), F.col("lon"), F.col("h")), (F.lit(1.0), F.lit(-2.0), F.lit(0.5)), F.lit(0.1))
    size = F.sqrt(sum((e * e for e in err[1:]), err[0] * err[0]))
    n, e, dd = geo.to_local((F.col("lat"), F.col("lon"), F.col("h")), (F.col("lat") - 0.001, F.col("lon") + 0.002, F.lit(100.0)))
    return p.select("k", *((F.round(x, 3) + 0.0).alias(a) for x, a in ((size, "error"), (n, "north"), (e, "east"), (dd, "down"))))


#: Level, so that the error is 3 + 1 - 1 north, 4 - 2 east, 0.5 down.
TRUTH_ERROR = f"""
WITH {POINTS}, o AS (SELECT *, lat - 0.001 AS la FROM pt), r AS (SELECT *, 6378137.0 * (1 - 0.00669437999014) / pow(1 - 0.00669437999014 * sin(la) ** 2, 1.5) AS m, 6378137.0 / sqrt(1 - 0.00669437999014 * sin(la) ** 2) AS n FROM o)
SELECT k, round(sqrt(9 + 4 + 0.25), 3) + 0e0 AS error, round(0.001 * (m + 100), 3) + 0e0 AS north, round(-0.002 * (n + 100) * cos(la), 3) + 0e0 AS east, round(100 - h, 3) + 0e0 AS down FROM r
"""


def _packed(x, size: int):
    """An integer column as little-endian bytes in hexadecimal."""
    x = x.cast("long") if size == 8 else x.cast("long").bitwiseAND(F.lit((1 << 8 * size) - 1))
    half = F.lit(0x0F0F0F0F0F0F0F0F)  # digits change places in their bytes, then all are turned round
    return F.reverse(F.lpad(F.hex(F.shiftleft(x.bitwiseAND(half), 4).bitwiseOR(F.shiftrightunsigned(x, 4).bitwiseAND(half))), 2 * size, "0"))


def position_messages(spark: SparkSession, d: str) -> DataFrame:
    """Position and velocity messages packed from keys and read again; every seventh is cut short."""
    k = F.col("o_orderkey")
    zero = lambda n: F.lit("00" * n)
    body = F.concat(zero(20), _packed(k % 6, 1), _packed(k % 256, 1), zero(1), _packed(k % 40, 1), _packed((k * 79190) % 3600000000 - 1800000000, 4), _packed((k * 1047290) % 1800000000 - 900000000, 4), _packed(k % 90000 - 400, 4), zero(4),
                    _packed(k % 5000, 4), _packed(k % 7000, 4), _packed(k % 3000 - 1500, 4), _packed(-(k % 2000), 4), _packed(k % 77, 4), zero(4), _packed((k * 31) % 36000000, 4), _packed(k % 900, 4), zero(12), _packed((k * 17) % 36000000 - 100, 4), zero(4))
    payload = F.unhex(F.when(k % 7 == 0, F.left(body, F.lit(100))).otherwise(body))
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", payload.alias("payload"))
    return rounded(o.select("o_orderkey", *(c.alias(n) for n, c in frames.nav_pvt(F.col("payload")).items())))


POSITION_MESSAGES = """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS k FROM orders)
SELECT o_orderkey, k % 6 AS fix_type, (k % 256) & 1 = 1 AS fix_ok, ((k % 256) >> 6) & 3 AS carr_soln, k % 40 AS num_sv, round(((k * 79190) % 3600000000 - 1800000000) * 1e-7, 6) AS lon_deg, round(((k * 1047290) % 1800000000 - 900000000) * 1e-7, 6) AS lat_deg,
  round((k % 90000 - 400) * 1e-3, 6) AS height_m, round((k % 5000) * 1e-3, 6) AS hacc_m, round((k % 7000) * 1e-3, 6) AS vacc_m, round((k % 3000 - 1500) * 1e-3, 6) AS vn, round(-(k % 2000) * 1e-3, 6) AS ve, round((k % 77) * 1e-3, 6) AS vd, round((k % 900) * 1e-3, 6) AS sacc_mps,
  round(((k * 31) % 36000000) * 1e-5, 6) AS head_mot_deg, round(((k * 17) % 36000000 - 100) * 1e-5, 6) AS head_veh_deg, ((k % 256) >> 5) & 1 = 1 AS head_veh_valid FROM o
"""


def rotation_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Quaternions through their matrices and back, and the vector of a turn about the down axis."""
    a = _angles(spark, d).select("*", *(c.alias(n) for c, n in zip(rotation.from_rpy(F.col("roll"), F.col("pitch"), F.col("yaw")), "wxyz", strict=True)))
    m = rotation.to_matrix(tuple(map(F.col, "wxyz")))
    a = a.select("*", *(m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)))
    b = a.select("*", *(c.alias(f"q{i}") for i, c in enumerate(rotation.from_matrix([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]))))
    same = F.abs(sum((F.col(x) * F.col(f"q{i}") for i, x in enumerate("wxyz")), F.lit(0.0)))
    down = rotation.rotation_vector(rotation.from_rpy(F.lit(0.0), F.lit(0.0), F.col("yaw")))[2]
    inside = rotation.within((F.col("roll"), F.col("pitch"), F.col("yaw")), 1.5)
    return rounded(b.select("k", same.alias("same"), down.alias("down"), inside.alias("inside")))


ROTATION_VECTORS = f"WITH {ANGLES} SELECT k, 1.0 AS same, round(atan2(sin(yaw), cos(yaw)), 6) AS down, abs(roll) <= 1.5 AND abs(pitch) <= 1.5 AND abs(yaw) <= 1.5 AS inside FROM an"


def fix_latency(spark: SparkSession, d: str) -> DataFrame:
    """Latency of orders as fixes, by a clock that runs 20 ppm fast."""
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (k * 1000 + 50_000).alias("t_us"), F.when(k % 4 != 0, 2000).otherwise(0).alias("gps_week"), (k * 1e-3).alias("gps_tow_s"))
    return rounded(quality.latency(o, F.lit(2000 * 604800.0), F.lit(1.00002e-6)).select("o_orderkey", "latency_ms"))


FIX_LATENCY = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN round((o_orderkey * 1000 + 50000 - (2000 * 604800e0 + o_orderkey * 1e-3 - 2000 * 604800e0) / 1.00002e-6) / 1e3, 6) END AS latency_ms FROM orders"


#: Numbers and their four bytes in IEEE form, the lowest first.
REALS = ((0.0, "00000000"), (1.0, "0000803F"), (-2.5, "000020C0"), (0.125, "0000003E"), (1000.0, "00007A44"))


def _real(k):
    return F.element_at(F.array(*(F.lit(h) for _, h in REALS)), (k % len(REALS)).cast("int") + 1)


def device_messages(spark: SparkSession, d: str) -> DataFrame:
    """A pulse, a speed, counters, a run of clipped samples, an inertial and a magnetic sample of a device for each part, as bytes, decoded."""
    k = F.col("p_partkey").cast("long")
    n = lambda a, m: k * a % m
    parts = {
        "pulse": [_packed(k * 1_000_003, 8), _packed(k, 4), _packed(n(7919, 604_800_000), 4), _packed(n(65_537, 4_294_967_296), 4), _packed(n(31, 2000) - 1000, 4), _packed(2200 + n(3, 100), 2), _packed(n(5, 32), 2)],
        "speed": [_packed(k * 1000, 8), _packed(k * 999, 8), _real(k), _real(k + 1), _packed(n(13, 500), 2), _packed(n(11, 32), 2), _packed(n(3, 4), 2)],
        "counters": [_packed(k * (i + 3), 4) for i in range(11)],
        "clipped": [_packed(n(101, 65_536), 2), _packed(n(103, 65_536), 2), _packed(n(7, 500), 2), _packed(n(1, 64), 1), _packed(n(1, 2), 1)],
        "imu": [_packed(k * 5000, 8), *(_real(k + i) for i in range(6)), _packed(n(77, 4096), 4), _packed(n(9, 65_536), 2)],
        "mag": [_packed(k * 5001, 8), *(_real(k + 2 * i) for i in range(3)), _real(k + 1)],
    }
    df = spark.read.parquet(f"{d}/part.parquet").select(k.alias("k"), *(F.unhex(F.concat(*p)).alias(name) for name, p in parts.items()))
    pulse, speed, count = frames.timesync(F.col("pulse")), frames.odometry(F.col("speed")), frames.counters(F.col("counters"))
    clip, imu, mag = frames.saturation(F.col("clipped")), frames.imu_sample(F.col("imu")), frames.mag_sample(F.col("mag"))
    r = lambda c: F.round(c, 6)
    return df.select(
        "k", pulse["t_us"].alias("pulse_t_us"), pulse["week"].alias("week"), pulse["q_err_ps"].alias("q_err_ps"), pulse["suspect"].alias("suspect"), r(pulse["tow_s"]).alias("tow_s"), F.round(pulse["gps_s"], 3).alias("gps_s"),
        r(speed["speed_mps"]).alias("speed_mps"), r(speed["stddev_mps"]).alias("stddev_mps"), speed["delay_ms"].alias("delay_ms"), speed["reverse"].alias("reverse"), speed["t_us_valid"].alias("t_us_valid"),
        count["imu_overruns"].alias("imu_overruns"), count["gnss_crc_errors"].alias("gnss_crc_errors"), F.get(count["extra"], F.lit(0)).alias("extra"),
        clip["samples"].alias("clipped"), F.array_join(clip["axes"], " ").alias("axes"), clip["dropped_before"].alias("dropped_before"),
        imu["t_us"].alias("imu_t_us"), r(imu["acc_x"]).alias("acc_x"), r(imu["gyr_z"]).alias("gyr_z"), imu["status_temp"].alias("status_temp"), imu["status_flags"].alias("status_flags"), imu["seq16"].alias("seq16"),
        mag["t_us"].alias("mag_t_us"), r(mag["mag_y"]).alias("mag_y"), r(mag["temp_c"]).alias("temp_c"),
    )


_R = "[" + ", ".join(f"{v}::DOUBLE" for v, _ in REALS) + "]"
DEVICE_MESSAGES = f"""
WITH p AS (SELECT p_partkey AS k, {_R} AS r, p_partkey * 5 % 32 AS pf, p_partkey * 11 % 32 AS sf, p_partkey % 64 AS mask, p_partkey * 77 % 4096 AS st,
  (p_partkey * 7919 % 604800000 + (p_partkey * 65537 % 4294967296) / 4294967296.0::DOUBLE) / 1e3 AS tow FROM part)
SELECT k, k * 1000003 AS pulse_t_us, 2200 + k * 3 % 100 AS week, k * 31 % 2000 - 1000 AS q_err_ps, pf & 16 > 0 AS suspect, CASE WHEN pf & 1 > 0 THEN round(tow, 6) END AS tow_s,
  CASE WHEN pf & 1 > 0 THEN round((2200 + k * 3 % 100) * 604800 + tow + CASE WHEN pf & 8 > 0 THEN (k * 31 % 2000 - 1000) * 1e-12 ELSE 0 END, 3) END AS gps_s,
  r[k % 5 + 1] AS speed_mps, r[(k + 1) % 5 + 1] AS stddev_mps, k * 13 % 500 AS delay_ms, sf & 3 = 3 AS reverse, sf & 16 > 0 AS t_us_valid, k * 4 AS imu_overruns, k * 12 AS gnss_crc_errors, k * 13 AS extra,
  k * 7 % 500 AS clipped, concat_ws(' ', CASE WHEN mask & 1 > 0 THEN 'acc_x' END, CASE WHEN mask & 2 > 0 THEN 'acc_y' END, CASE WHEN mask & 4 > 0 THEN 'acc_z' END, CASE WHEN mask & 8 > 0 THEN 'gyr_x' END, CASE WHEN mask & 16 > 0 THEN 'gyr_y' END, CASE WHEN mask & 32 > 0 THEN 'gyr_z' END) AS axes,
  k % 2 = 1 AS dropped_before, k * 5000 AS imu_t_us, round(r[k % 5 + 1] * 9.80665, 6) AS acc_x, round(r[(k + 5) % 5 + 1] * 0.017453292519943295, 6) AS gyr_z,
  CASE WHEN st & 2047 >= 1024 THEN (st & 2047) - 2048 ELSE st & 2047 END AS status_temp, st >> 11 AS status_flags, k * 9 % 65536 AS seq16, k * 5001 AS mag_t_us, r[(k + 2) % 5 + 1] AS mag_y, r[(k + 1) % 5 + 1] AS temp_c FROM p
"""


def setting_items(spark: SparkSession, d: str) -> DataFrame:
    """Three items of keys and values in one payload for each part: one byte, four bytes, and bytes that bring their width."""
    k = F.col("p_partkey").cast("long")
    one, four, more = (F.lit(kind << 28).cast("long") + k % 1000 for kind in (2, 4, 6))
    width = k % 5
    text = F.expr("repeat('AB', cast(p_partkey % 5 as int))")
    payload = F.concat(F.lit("00010100"), _packed(one, 4), _packed(k % 256, 1), _packed(four, 4), _packed(k * 7, 4), _packed(more, 4), _packed(width, 2), text)
    df = spark.read.parquet(f"{d}/part.parquet").select(k.alias("k"), F.unhex(F.when(k % 17 == 0, F.substring(payload, 1, 30)).otherwise(payload)).alias("payload"))
    out = frames.value_items(F.col("payload"))
    return df.select("k", out["layer"].alias("layer"), F.explode(F.coalesce(out["items"], F.array(F.struct(F.lit(-1).cast("long").alias("key"), F.unhex(F.lit("")).alias("value"))))).alias("i")).select("k", "layer", "i.key", F.hex("i.value").alias("value"))


SETTING_ITEMS = """
WITH p AS (SELECT p_partkey AS k FROM part), le AS (SELECT k, lpad(hex(k * 7), 8, '0') AS h, lpad(hex(k % 256), 2, '0') AS b FROM p)
SELECT k, 1::BIGINT AS layer, (2::BIGINT << 28) + k % 1000 AS key, b AS value FROM le WHERE k % 17 > 0
UNION ALL SELECT k, 1, (4::BIGINT << 28) + k % 1000, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) FROM le WHERE k % 17 > 0
UNION ALL SELECT k, 1, (6::BIGINT << 28) + k % 1000, repeat('AB', CAST(k % 5 AS INT)) FROM le WHERE k % 17 > 0
UNION ALL SELECT k, 1, -1, '' FROM le WHERE k % 17 = 0
"""

WITH_SQL = (device_messages, setting_items, fix_gates, truth_error, position_messages, rotation_vectors, fix_latency, geodesy_ecef, geodesy_radii, geodesy_distance, map_tiles, isa_altitude, attitude_roundtrip, attitude_rate, levelling, covariance_conditioned, error_ellipses, growth_rate, gate_codes, fletcher_checksum, gram_matrix)
WITHOUT_SQL = ()
