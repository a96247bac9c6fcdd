"""Size of the Arrow batches in which texts go to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """At most ROWS rows a batch in this session: with whole texts, the default of 10,000 takes tens of MB in each of several buffers."""
    now = int(spark.conf.get(_KEY))
    if now <= 0 or now > ROWS:
        spark.conf.set(_KEY, ROWS)
