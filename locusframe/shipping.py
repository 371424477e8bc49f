"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once a Spark application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="locusframe-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as packed:
        for source in sorted(home.rglob("*.py")):
            packed.write(source, source.relative_to(home.parent).as_posix())
    context.addPyFile(path)
    _shipped.add(context.applicationId)
