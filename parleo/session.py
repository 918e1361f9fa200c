"""Session defaults shared by tests, bench and notebooks."""
from __future__ import annotations

import os

from pyspark import SparkConf
from pyspark.sql import SparkSession


def make_session(app: str = "parleo", cores: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and bench; whatever was submitted (command line, defaults file) wins over these settings."""
    submitted = SparkConf()
    builder = SparkSession.builder.appName(app)
    for key, value in {
        "spark.master": f"local[{cores}]",
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",  # small test data: keep all cores busy
        "spark.driver.memory": os.environ.get("PARLEO_DRIVER_MEMORY", memory),
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # a stack walk for every column expression
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }.items():
        if not submitted.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
