"""A session with the settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tallyforge", **conf: str) -> SparkSession:
    """UTC timestamps and adaptive execution; everything else is the cluster's, or what is passed with dots as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
