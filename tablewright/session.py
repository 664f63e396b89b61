"""A session with the settings the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "tablewright", **settings: str) -> SparkSession:
    """UTC time, adaptive execution, and ``settings`` on top."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=conf | settings).getOrCreate()
