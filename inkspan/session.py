"""Session factory used by the tests, the bench and ad-hoc work."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "inkspan", cores: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with AQE on and UTC time. On a cluster, use the session that spark-submit gives."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
