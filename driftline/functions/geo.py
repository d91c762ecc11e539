"""Geodesy as column expressions: WGS84 positions, local frames, gravity, map tiles. Angles in radians unless named _deg."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 and Somigliana normal gravity.
A, E2, FLATTENING, M = 6378137.0, 0.00669437999014, 3.35281066475e-3, 3.44978650684e-3
GAMMA_E, G1, G2, G3 = 9.7803253359, 5.27904265e-3, 2.32718e-5, 1.26209e-7
OMEGA_E = 7.292115e-5
B = A * (1 - E2) ** 0.5


def transverse_radius(lat: Column) -> Column:
    return F.lit(A) / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))


def meridian_radius(lat: Column) -> Column:
    s = 1 - E2 * F.sin(lat) * F.sin(lat)
    return F.lit(A * (1 - E2)) / (s * F.sqrt(s))


def llh_to_ecef(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    n = transverse_radius(lat)
    return (n + h) * F.cos(lat) * F.cos(lon), (n + h) * F.cos(lat) * F.sin(lon), (n * (1 - E2) + h) * F.sin(lat)


def ecef_to_llh(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """One pass of Bowring's formula; the height from the larger of the cosine and the sine."""
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * A, p * B)
    ep2 = E2 / (1 - E2)
    lat = F.atan2(z + ep2 * B * F.pow(F.sin(t), 3), p - E2 * A * F.pow(F.cos(t), 3))
    n = transverse_radius(lat)
    high = F.abs(F.cos(lat)) >= F.abs(F.sin(lat))
    return lat, F.atan2(y, x), F.when(high, p / F.cos(lat) - n).otherwise(z / F.sin(lat) - n * (1 - E2))


def ned_to_ecef_matrix(lat: Column, lon: Column) -> list[list[Column]]:
    sl, cl, so, co = F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)
    return [[-sl * co, -so, -cl * co], [-sl * so, co, -cl * so], [cl, F.lit(0.0), -sl]]


def position_error(estimate: tuple[Column, Column, Column], attitude: list[list[Column]], velocity: tuple[Column, Column, Column], truth: tuple[Column, Column, Column], lever_arm: tuple[Column, Column, Column], dt_s: Column) -> tuple[Column, Column, Column]:
    """Estimate less truth in ECEF, in m.

    estimate: ECEF; attitude: body to local; truth: latitude, longitude, height of the point that lever_arm (body) leads to;
    the estimate is carried back by its own velocity over dt_s, the time by which it is younger than the truth.
    """
    at = llh_to_ecef(*truth)
    local = [sum((attitude[i][k] * lever_arm[k] for k in range(1, 3)), attitude[i][0] * lever_arm[0]) - velocity[i] * dt_s for i in range(3)]
    m = ned_to_ecef_matrix(truth[0], truth[1])
    return tuple(estimate[i] - at[i] + m[i][0] * local[0] + m[i][1] * local[1] + m[i][2] * local[2] for i in range(3))


def to_local(truth: tuple[Column, Column, Column], origin: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """North, east and down of a point from an origin (both latitude, longitude, height), by the origin's curvature radii."""
    n, e, d = (truth[0] - origin[0]) * (meridian_radius(origin[0]) + origin[2]), wrap_pi(truth[1] - origin[1]) * (transverse_radius(origin[0]) + origin[2]) * F.cos(origin[0]), origin[2] - truth[2]
    return n, e, d


def dned_to_dllh(dn: Column, de: Column, dd: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    return dn / (meridian_radius(lat) + h), de / ((transverse_radius(lat) + h) * F.greatest(F.cos(lat), F.lit(1e-6))), -dd


def dllh_to_dned(dlat: Column, dlon: Column, dh: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    return dlat * (meridian_radius(lat) + h), dlon * (transverse_radius(lat) + h) * F.greatest(F.cos(lat), F.lit(1e-6)), -dh


def normal_gravity(lat: Column, h: Column) -> Column:
    """Somigliana series with the free-air correction."""
    s2 = F.sin(lat) * F.sin(lat)
    g0 = GAMMA_E * (1 + G1 * s2 + G2 * s2 * s2 + G3 * s2 * s2 * s2)
    return g0 * (1 - 2 / A * (1 + FLATTENING + M - 2 * FLATTENING * s2) * h + 3 / (A * A) * h * h)


def navigation_rate(lat: Column, h: Column, vn: Column, ve: Column) -> tuple[Column, Column, Column]:
    """Earth rate and transport rate in the local frame."""
    east = ve / (transverse_radius(lat) + h)
    return OMEGA_E * F.cos(lat) + east, -vn / (meridian_radius(lat) + h), -OMEGA_E * F.sin(lat) - east * F.tan(lat)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * A * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def tile(lat_deg: Column, lon_deg: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator tile coordinates, with their fractions."""
    n, lat = 2.0**zoom, F.radians(lat_deg)
    return (lon_deg + 180) / 360 * n, (1 - F.log(F.tan(lat) + 1 / F.cos(lat)) / 3.141592653589793) / 2 * n


def metres_per_pixel(lat_deg: Column, zoom: int) -> Column:
    return F.cos(F.radians(lat_deg)) * (2 * 3.141592653589793 * A / (256 * 2.0**zoom))


def mercator(lat_deg: Column, lon_deg: Column) -> tuple[Column, Column]:
    return A * F.radians(lon_deg), A * F.log(F.tan(3.141592653589793 / 4 + F.radians(lat_deg) / 2))


def wrap_pi(a: Column) -> Column:
    return F.atan2(F.sin(a), F.cos(a))


def error_ellipse(nn: Column, ne: Column, ee: Column) -> tuple[Column, Column, Column]:
    """Semi-axes, and the angle of the larger from north towards east."""
    mean, half = (nn + ee) / 2, (nn - ee) / 2
    root = F.sqrt(half * half + ne * ne)
    return F.sqrt(F.greatest(mean + root, F.lit(0.0))), F.sqrt(F.greatest(mean - root, F.lit(0.0))), 0.5 * F.atan2(2 * ne, nn - ee)


def signed_root(c: Column) -> Column:
    return F.signum(c) * F.sqrt(F.abs(c))
