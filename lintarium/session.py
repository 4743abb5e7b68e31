"""Session defaults shared by tests, the benchmark and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lintarium", cores: str = "*", partitions: int | None = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC with adaptive execution; on a cluster use the session that spark-submit gives."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
