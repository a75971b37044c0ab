"""Session settings and scratch storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture slows down plan building by far more than planning itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tsengine", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings the operators expect; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Only a local session without ``spark.checkpoint.dir`` (tests) gets a temporary
    folder; on a cluster that would be each machine's own, so it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tsengine-")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write a table that a loop goes on from; a lost executor then costs a read, and plans stay short."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
