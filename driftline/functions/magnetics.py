"""The earth's magnetic field from spherical harmonic coefficients.

The coefficients are a parameter: a table of degree, order, g, h and their yearly
changes, which `read_coefficients` takes from the text form in which the world
magnetic model is published. Degree and order are what the table has.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.geo import A, E2
from driftline.shipping import shipped

#: The field's reference radius in m; how near a dip pole (degrees) a compass shows no heading.
RADIUS, POLE_DEG = 6_371_200.0, 5.0


@dataclass
class Model:
    """Schmidt semi-normalised coefficients in nT, [degree, order], and their changes a year from the epoch."""

    epoch: float
    g: np.ndarray
    h: np.ndarray
    dg: np.ndarray
    dh: np.ndarray

    def at(self, year: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients [..., degree, order] at decimal years."""
        dt = (np.asarray(year, float) - self.epoch)[..., None, None]
        return self.g + dt * self.dg, self.h + dt * self.dh

    def field(self, lat: np.ndarray, lon: np.ndarray, height: np.ndarray, year: np.ndarray) -> np.ndarray:
        """North, east and down in nT at geodetic radians and metres: [points, 3]."""
        lat, lon, height, year = (np.atleast_1d(np.asarray(x, float)) for x in np.broadcast_arrays(lat, lon, height, year))
        n_curve = A / np.sqrt(1 - E2 * np.sin(lat) ** 2)
        across, up = (n_curve + height) * np.cos(lat), (n_curve * (1 - E2) + height) * np.sin(lat)
        r, centric = np.hypot(across, up), np.arctan2(up, across)
        c, s = np.sin(centric), np.maximum(np.cos(centric), 1e-10)  # of the angle from the pole
        g, h = self.at(year)
        size = self.g.shape[0] - 1
        # Legendre functions and their derivatives by the angle from the pole, order by order, degree by degree.
        p, dp = np.zeros((size + 1, size + 1, len(lat))), np.zeros((size + 1, size + 1, len(lat)))
        p[0, 0] = 1
        for m in range(size + 1):
            if m:
                f = np.sqrt((2 * m - 1) / (2 * m)) if m > 1 else 1.0
                p[m, m], dp[m, m] = f * s * p[m - 1, m - 1], f * (c * p[m - 1, m - 1] + s * dp[m - 1, m - 1])
            for n in range(m + 1, size + 1):
                k, before = np.sqrt(n * n - m * m), np.sqrt((n - 1) ** 2 - m * m) if n > m + 1 else 0.0
                older, d_older = (p[n - 2, m], dp[n - 2, m]) if n > m + 1 else (0.0, 0.0)
                p[n, m] = ((2 * n - 1) * c * p[n - 1, m] - before * older) / k
                dp[n, m] = ((2 * n - 1) * (c * dp[n - 1, m] - s * p[n - 1, m]) - before * d_older) / k
        north, east, down = np.zeros(len(lat)), np.zeros(len(lat)), np.zeros(len(lat))
        for n in range(1, size + 1):
            ratio = (RADIUS / r) ** (n + 2)
            for m in range(n + 1):
                cos, sin = np.cos(m * lon), np.sin(m * lon)
                part = g[:, n, m] * cos + h[:, n, m] * sin
                north += ratio * part * dp[n, m]
                east += ratio * m * (g[:, n, m] * sin - h[:, n, m] * cos) * p[n, m] / s
                down -= ratio * (n + 1) * part * p[n, m]
        turn = centric - lat  # from geocentric to geodetic
        return np.stack([north * np.cos(turn) - down * np.sin(turn), east, north * np.sin(turn) + down * np.cos(turn)], 1)

    def dip_poles(self, year: float) -> np.ndarray:
        """Latitude and longitude where the field is vertical: the least horizontal part, from a grid on by Gauss-Newton."""
        lat, lon = (x.ravel() for x in np.meshgrid(np.radians(np.arange(-88, 89, 4.0)), np.radians(np.arange(-180, 180, 8.0)), indexing="ij"))
        b = self.field(lat, lon, 0.0, year)
        out = []
        for north in (True, False):
            own = np.flatnonzero(lat > 0 if north else lat < 0)
            at = own[np.argmin(np.hypot(b[own, 0], b[own, 1]))]
            # Towards the pole meridians meet: steps are taken in a plane that touches the sphere here.
            u = np.array([np.cos(lat[at]) * np.cos(lon[at]), np.cos(lat[at]) * np.sin(lon[at]), np.sin(lat[at])])
            for _ in range(50):
                x = np.cross(u, np.eye(3)[np.argmin(np.abs(u))])
                x /= np.linalg.norm(x)
                y = np.cross(u, x)

                def flat(a: float, c: float, u=u, x=x, y=y) -> np.ndarray:
                    v = u + a * x + c * y
                    v /= np.linalg.norm(v)
                    la, lo = np.arcsin(v[2]), np.arctan2(v[1], v[0])
                    n, e, _ = self.field(la, lo, 0.0, year)[0]
                    to_n = np.array([-np.sin(la) * np.cos(lo), -np.sin(la) * np.sin(lo), np.cos(la)])
                    total = n * to_n + e * np.array([-np.sin(lo), np.cos(lo), 0])
                    return np.array([total @ x, total @ y])

                f0, step = flat(0.0, 0.0), 1e-5
                jac = np.stack([(flat(step, 0.0) - f0) / step, (flat(0.0, step) - f0) / step], 1)
                d = np.linalg.solve(jac, -f0)
                d *= min(1.0, 0.1 / max(np.linalg.norm(d), 1e-12))
                u = u + d[0] * x + d[1] * y
                u /= np.linalg.norm(u)
                if np.linalg.norm(d) < 1e-10:
                    break
            out.append([np.arcsin(u[2]), np.arctan2(u[1], u[0])])
        return np.array(out)


def model(rows: list[tuple], epoch: float) -> Model:
    """rows: degree, order, g, h, and, where given, their changes a year."""
    size = max(r[0] for r in rows) + 1
    parts = np.zeros((4, size, size))
    for n, m, *values in rows:
        parts[: len(values), n, m] = values
    return Model(epoch, *parts)


def read_coefficients(spark: SparkSession, path: str) -> Model:
    """A published coefficient file: a header with the epoch, then rows of degree, order, g, h and their changes; 9s end it."""
    text = [r["value"].split() for r in spark.read.text(path).collect()]  # a few hundred lines at most
    rows = [(int(w[0]), int(w[1]), *map(float, w[2:6])) for w in text[1:] if len(w) >= 6]
    return model(rows, float(text[0][0]))


def magnetic_elements(df: DataFrame, coefficients: Model, lat: str = "lat", lon: str = "lon", height: str = "height", year: str = "year") -> DataFrame:
    """df with north, east, down, strength, horizontal (nT), declination, inclination and pole_distance (degrees), and heading_valid.

    lat, lon: geodetic radians. Null coordinates give nulls. The dip poles are those of the middle of the row's year.
    """
    shipped(df.sparkSession)

    @F.pandas_udf("north double, east double, down double, strength double, horizontal double, declination double, inclination double, pole_distance double, heading_valid boolean")
    def elements(a: pd.Series, o: pd.Series, z: pd.Series, t: pd.Series) -> pd.DataFrame:
        x = np.stack([s.to_numpy(float) for s in (a, o, z, t)])
        ok = np.isfinite(x).all(0)
        out = np.full((len(a), 8), np.nan)
        if ok.any():
            la, lo, h, years = x[:, ok]
            b = coefficients.field(la, lo, h, years)
            flat = np.hypot(b[:, 0], b[:, 1])
            near = np.full(len(la), np.pi)
            for whole in np.unique(np.floor(years)):
                own = np.floor(years) == whole
                for pa, po in coefficients.dip_poles(whole + 0.5):
                    near[own] = np.minimum(near[own], np.arccos(np.clip(np.sin(la[own]) * np.sin(pa) + np.cos(la[own]) * np.cos(pa) * np.cos(lo[own] - po), -1, 1)))
            out[ok] = np.column_stack([b, np.linalg.norm(b, axis=1), flat, np.degrees(np.arctan2(b[:, 1], b[:, 0])), np.degrees(np.arctan2(b[:, 2], flat)), np.degrees(near)])
        frame = pd.DataFrame(out, columns=["north", "east", "down", "strength", "horizontal", "declination", "inclination", "pole_distance"])
        return frame.assign(heading_valid=np.where(ok, out[:, 7] >= POLE_DEG, None))

    return df.withColumn("__m", elements(lat, lon, height, year)).select(*df.columns, "__m.*")
