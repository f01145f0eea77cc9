"""The session that the library expects: UTC, ANSI SQL, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "ridgeline", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
