"""What a session needs before operators run in it."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch on its way to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library, whatever folder they start in, and bound their batches by bytes."""
    if int(str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])
    return spark
