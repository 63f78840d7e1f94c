"""A session with the settings that the queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lodestrata", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; anything else is left to the cluster."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (fixed | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
