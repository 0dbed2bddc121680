"""A session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quarrylog", **conf: str) -> SparkSession:
    """The running session, or a new one in UTC with adaptive execution; conf: further settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
