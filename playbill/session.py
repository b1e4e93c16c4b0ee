"""A session as the jobs expect it: UTC, adaptive execution, skewed joins split."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "playbill", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
