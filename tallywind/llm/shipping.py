"""Sends this package to the executors, so that a session that was started without it on its Python path can run the operators."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application; Spark serves the archive from the driver."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        package = Path(__file__).resolve().parent.parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='package-')}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _SENT.add(app)
