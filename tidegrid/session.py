"""A session with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidegrid", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC (calendar arithmetic on TIMESTAMP_NTZ goes through the session's zone); partitions follow the cluster unless given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
