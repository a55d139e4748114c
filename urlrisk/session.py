"""Session defaults for running the engine outside a managed cluster (tests, bench, notebooks)."""

from __future__ import annotations

import os

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession


def _submitted() -> SparkConf | None:
    """The settings of spark-submit, if it started this process."""
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return None
    SparkContext._ensure_initialized()
    return SparkConf()


def build_session(
    master: str = "local[8]", shuffle_partitions: int = 8, driver_memory: str = "8g", app: str = "urlrisk"
) -> SparkSession:
    """A session with adaptive execution and skew-join splitting on; what was submitted wins.

    Files below the checkpoint folder that belong to dropped checkpoints are cleaned up; tables that
    operators write there stay until the folder's owner removes them.
    """
    wanted = {
        "spark.master": master,
        "spark.app.name": app,
        "spark.driver.memory": driver_memory,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    submitted = _submitted()
    builder = SparkSession.builder
    for key, value in wanted.items():
        if submitted is None or not submitted.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
