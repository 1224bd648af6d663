from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import SparkSession

from charscape.session import BUILD_SETTINGS, SETTINGS


def local_session() -> SparkSession:
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("charscape-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    for key, value in {**SETTINGS, **BUILD_SETTINGS}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return local_session()
