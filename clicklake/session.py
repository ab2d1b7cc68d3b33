"""A Spark session with the settings that the library's results rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "clicklake", **conf: str) -> SparkSession:
    """UTC, adaptive execution, dynamic partition overwrite. Sizes of shuffles and broadcasts stay Spark's to choose."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()
