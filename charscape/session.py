"""Session settings the plans rely on.

Only what differs from Spark's defaults, or must not be switched off, is listed. Partition counts
and memory belong to the cluster.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a crowded map cell even where the grouping after the join then needs a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.exchange.reuse": "true",
}

# Only for session builders: recording the call site of every column expression slows down the
# construction of large plans on the driver.
BUILD_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
