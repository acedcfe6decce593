"""Session with the settings the operators count on: UTC, adaptive execution, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app_name: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
