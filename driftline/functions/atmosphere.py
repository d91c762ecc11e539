"""International standard atmosphere as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sea-level pressure in Pa, scale in m, exponent, and the plausible range in Pa.
P0, SCALE, EXPONENT, LOW, HIGH = 101325.0, 44330.0, 1 / 5.255, 10_000.0, 120_000.0


def altitude(pressure: Column) -> Column:
    """Pressure altitude in m; null where the pressure is not positive."""
    return F.when((pressure > 0) & ~F.isnan(pressure), SCALE * (1 - F.pow(pressure / P0, EXPONENT)))


def plausible(pressure: Column) -> Column:
    return F.coalesce(~F.isnan(pressure) & pressure.between(LOW, HIGH), F.lit(False))
