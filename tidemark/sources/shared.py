"""A folder that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a session on one machine names no shared folder (local runs and tests).
LOCAL = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """A new folder's URI under spark.checkpoint.dir. On a cluster that setting has to be there: a folder of each
    machine's own would lose what the others write."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        base = LOCAL
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what reads it neither makes it again nor needs the executors that made it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
