"""The Spark session that tests, benchmarks and scripts use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster spark-submit's own settings win over these defaults."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one that the session names in spark.checkpoint.dir; a session on one machine that names
    none gets a local folder, on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "graphloom-scratch")
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
