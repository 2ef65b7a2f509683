"""Session settings the jobs rely on. A cluster's own settings win: nothing set there is overridden."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(name: str, cores: int = 8, memory: str = "8g", extra: dict[str, str] | None = None) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    settings = {
        **DEFAULTS, "spark.sql.shuffle.partitions": str(cores), "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": memory, **(extra or {}),
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
