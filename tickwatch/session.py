"""A session set up for the package; any session in UTC will do as well."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "tickwatch", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # plans are built from many small expressions; recording a call site for each is slow
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.ui.enabled", "false").config(
                "spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g")
            )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
