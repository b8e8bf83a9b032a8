"""Time buckets of a tape whose trades are published again, with corrections of buckets that were told before.

A stream keeps the latest revision of each trade and the buckets that the trade has ever been in. What changes in a
micro-batch goes to a table of trades by day, as the trade in its bucket and as a withdrawal in every other one, so
each bucket can be made from its own day alone. The buckets that a batch touches are made again and appended as
that batch's corrections. A batch that runs again writes over its own folders, so a restart tells nothing twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.expressions import bucket_start
from ..operators.core import latest
from ..operators.tape import ID, TIES, bucket_aggregates, keys


def latest_revisions(tape: DataFrame, dataset: str, bucket_seconds: int, by: Sequence[str], keep: str | None = None) -> DataFrame:
    """For each trade of a stream, in update mode: `trade`, its latest revision, and `places`, its buckets so far.

    The state is one row for each trade, spread by market and id. With keep, trades of a day are forgotten that long
    after it: a later revision then counts as a trade of its own, and so does one that moves to another day.
    """
    tape = tape.withColumn("bucket_start", bucket_start(F.col("event_time"), bucket_seconds))
    group = list(keys(dataset))
    if keep:
        tape = tape.withColumn("__at", F.col("event_time").cast("timestamp")).withWatermark("__at", keep)
        group.append(F.window("__at", "1 day"))
    trade = F.struct(*[c for c in tape.columns if c != "__at"])
    order = F.struct("imported_at", *TIES)
    return tape.groupBy(*group).agg(F.max_by(trade, order).alias("trade"), F.collect_set(F.struct(*by, "bucket_start")).alias("places")).select("trade", "places")


@dataclass(frozen=True)
class RevisedBuckets:
    """Buckets under a folder that the driver and all executors see.

    `trades/day=/batch=` holds revisions and withdrawals, `buckets/batch=` the corrections. A batch reads the days that it
    touches, so its cost is theirs and not the history's. Times and ids of trades are not null; repeated rows of one
    revision are one. Of equal imports the greatest price, then quantity, is the latest, as in the batch operators.
    """

    path: str
    dataset: str
    bucket_seconds: int
    by: tuple[str, ...] = ("market", "symbol")
    floor: float = 0
    keep: str | None = None

    def start(self, tape: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """tape: a stream of revisions with imported_at. trigger: as DataStreamWriter.trigger takes it."""
        changed = latest_revisions(tape, self.dataset, self.bucket_seconds, self.by, self.keep)
        out = changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(self.write)
        return (out.trigger(**trigger) if trigger else out).start()

    def write(self, changed: DataFrame, batch: int) -> None:
        """Keeps what a batch changes and tells the buckets that it touches."""
        spark = changed.sparkSession
        place = [*self.by, "bucket_start"]
        rows = changed.select("trade", F.explode("places").alias("place"))
        here = F.struct(*[F.col(f"trade.{c}").alias(c) for c in place])
        rest = [c for c in changed.schema["trade"].dataType.names if c not in place]
        rows = rows.select("place.*", *[F.col(f"trade.{c}") for c in rest], (F.col("place") == here).alias("live"))
        rows = rows.withColumns({"day": F.to_date("bucket_start").cast("string"), "batch": F.lit(batch).cast("long")})
        self._put(rows, "trades", "day", "batch")
        mine = spark.read.schema(rows.schema).parquet(f"{self.path}/trades").where(F.col("batch") == batch)
        # Days and no rows come to the driver, so that no other day's folder is listed.
        days = [r["day"] for r in mine.select("day").distinct().collect()]
        if not days:
            return
        touched = mine.select("day", *place).distinct()
        held = spark.read.schema(rows.schema).option("basePath", f"{self.path}/trades").parquet(*[f"{self.path}/trades/day={d}" for d in days])
        held = held.join(touched, ["day", *place], "left_semi")
        live = latest(held, (*place, ID[self.dataset]), TIES).where("live")
        made = live.groupBy(*place).agg(*bucket_aggregates(self.dataset, self.floor))
        out = touched.drop("day").join(made, place, "left").withColumn("trade_count", F.coalesce("trade_count", F.lit(0)))
        self._put(out.withColumn("batch", F.lit(batch).cast("long")), "buckets", "batch")

    def _put(self, df: DataFrame, table: str, *parts: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.path}/{table}")

    def corrections(self, spark: SparkSession) -> DataFrame:
        """All that was ever told: a bucket's row of each batch that touched it, and `revision` from 1. A bucket
        that all trades have left has no trades."""
        told = spark.read.parquet(f"{self.path}/buckets")
        return told.withColumn("revision", F.row_number().over(Window.partitionBy(*self.by, "bucket_start").orderBy("batch")))

    def buckets(self, spark: SparkSession) -> DataFrame:
        """The buckets as they are now."""
        told = spark.read.parquet(f"{self.path}/buckets")
        return latest(told, (*self.by, "bucket_start"), by="batch").where("trade_count > 0").drop("batch")
