"""Time buckets of a growing tape. Beyond batch parity: a watermark bounds what is kept, so a trade that comes
later than it is left out, and a republished trade does not replace the first one. revisions.py
keeps the latest revisions, and corrects buckets that were told."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import BUCKET_ORIGIN
from ..operators.tape import ID, bucket_aggregates


def read_tape(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bucket_stream(tape: DataFrame, dataset: str, bucket_seconds: int, late: str = "1 hour", by: Sequence[str] = ("market", "symbol"), floor: float = 0) -> DataFrame:
    """Closed buckets, once each, for an append sink. event_time is a timestamp here, as watermarks need it."""
    seen = tape.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", late)
    seen = seen.dropDuplicatesWithinWatermark(["market", ID[dataset]])
    w = f"{bucket_seconds} seconds"
    out = seen.groupBy(*by, F.window("event_time", w, w, f"{BUCKET_ORIGIN % bucket_seconds} seconds").alias("w")).agg(*bucket_aggregates(dataset, floor))
    return out.select(*by, F.col("w.start").alias("bucket_start"), *[c for c in out.columns if c not in (*by, "w")])
