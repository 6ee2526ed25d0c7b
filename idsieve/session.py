"""A Spark session with the settings that the queries assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "idsieve", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """UTC times and adaptive execution; master and partitions only where the cluster doesn't set them."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
