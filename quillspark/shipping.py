"""Makes this package importable on the executors, wherever the driver found it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="quillspark-"), "quillspark_package")
    context.addPyFile(shutil.make_archive(name, "zip", top, "quillspark"))
    _shipped.add(context.applicationId)
