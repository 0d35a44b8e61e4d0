"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, name: str = "millrace", **more: str) -> SparkSession:
    """Make or get a session; ``more`` are settings with underscores for dots."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
