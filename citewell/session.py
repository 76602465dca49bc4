"""Session factory for local work; a cluster passes its own session in."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "citewell", cores: int | None = None, shuffle: int = 8) -> SparkSession:
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CITEWELL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
