"""Session settings shared by tests, the bench and stand-alone runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings that results or plans depend on. Everything else stays with the cluster.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join is split even where that costs one more exchange afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

BATCH_BYTES = 4 << 20


def use_runtime_settings(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session somebody else created."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def use_small_batches(spark: SparkSession) -> SparkSession:
    """Whole texts go to Python workers in batches of about `BATCH_BYTES`; a smaller size that somebody set stays.

    10,000 texts at once are held several times, by the executor and by its Python workers.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key, None) or 0) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def local_session(cpus: int | str = 8, app: str = "fleetkpi", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FLEETKPI_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        # recording the call site of every column costs more than building the plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
