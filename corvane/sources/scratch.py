"""Where queries write what they read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder; where none is set and Spark runs on this machine alone, one of it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and folder.isDefined():
        base = folder.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """A table written to the scratch folder and read again: what is random or costly in it happens once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
