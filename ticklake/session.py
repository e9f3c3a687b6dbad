"""Session settings that the engine's semantics need: UTC, and adaptive plans."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "ticklake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and dynamic partition overwrite; further settings by keyword with _ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
