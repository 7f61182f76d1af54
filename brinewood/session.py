"""A Spark session with the settings the engine is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution. ``master``: None keeps what spark-submit or the cluster sets."""
    builder = SparkSession.builder.appName("brinewood").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return (builder.master(master) if master else builder).getOrCreate()
