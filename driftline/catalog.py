"""All queries of the library by name, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.plans import diagnostics, navigation, scalars, streams

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "gap_statistics"
MODULES = (streams, scalars, diagnostics, navigation)


def queries() -> dict[str, Query]:
    return {f.__name__: f for m in MODULES for f in (*m.WITH_SQL, *m.WITHOUT_SQL)}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: getattr(m, f.__name__.upper()) for m in MODULES for f in m.WITH_SQL}
