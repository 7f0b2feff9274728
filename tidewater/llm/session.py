"""Session settings that operators on texts need."""

from __future__ import annotations

from pyspark.sql import SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Send at most ``ROWS`` rows at a time to Python workers, unless the session says otherwise.

    Spark's own 10000 is meant for narrow rows; of long texts so many do not fit beside each other.
    """
    if spark.conf.get(ARROW_ROWS, None) is None:
        spark.conf.set(ARROW_ROWS, str(ROWS))
