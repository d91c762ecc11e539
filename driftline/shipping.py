"""The package for Python workers that do not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
_sent: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Sends the package's modules to the executors through Spark, once for an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        path = Path(tempfile.mkdtemp()) / "driftline.zip"  # of the driver alone; Spark serves it to the executors
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(HERE.rglob("*.py")):
                z.write(f, f.relative_to(HERE.parent))
        sc.addPyFile(str(path))
        _sent.add(sc.applicationId)
