"""Session builder with the settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "fringework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC; anything in ``conf`` overrides the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
