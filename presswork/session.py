"""A session with the settings the engine is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "presswork", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


#: Bytes of a batch of rows that goes to a Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Batches for Python workers are bounded by bytes, not by rows alone; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int((spark.conf.get(name, None) or "0b").rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
    return spark
