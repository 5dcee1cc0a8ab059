"""Makes this package importable on the executors, and bounds what a Python worker is sent at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..shipping import ship as _ship_package

#: A worker holds a whole Arrow batch and what it makes of it: Spark's 10,000 rows may be gigabytes of long texts.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def _bound_batches(spark: SparkSession) -> None:
    """Lowers the session's batch bounds to these; lower ones stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application, and bounds the session's batches."""
    _bound_batches(spark)
    _ship_package(spark)
