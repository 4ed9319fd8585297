"""A Spark session with the settings that this package is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", **conf: str) -> SparkSession:
    """conf overrides the settings; dots in names are given as double underscores."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.legacy.parquet.nanosAsLong": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.io.compression.codec": "zstd",
    }
    builder = SparkSession.builder.appName(name)
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
