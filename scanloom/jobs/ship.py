"""Makes this package importable in the Python workers of a cluster that doesn't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship_package(spark: SparkSession) -> None:
    """Send the package's source to the executors as a zip file, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_scanloom_shipped", False):
        return
    handle, path = tempfile.mkstemp(prefix="scanloom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(path)
    context._scanloom_shipped = True
