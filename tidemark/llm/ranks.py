"""Places of rows in an order, without one task that sees them all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import partitions_for, ragged, staged

#: Bytes that a row takes in a sort, about.
ROW_BYTES = 128


def numbered(df: DataFrame, order: list[Column], key: str | None = None) -> DataFrame:
    """df's rows with `place`: from 0 in the order, or from 0 for each value of key (a long that the order has to
    begin with, not null). df is read twice, so it should be a table; so is the result, in the shared folder.

    Rows are dealt to sorted partitions by range and counted there; a key's rows in earlier partitions are added. Of
    those sums a partition needs one at most, for the key that it begins with. A key with very many rows lies
    in many partitions. Rows that the whole order can't tell apart stay together, so it should end with something
    that is unlike in most rows.
    """
    group = F.col(key) if key else F.lit(0).cast("long")
    n = partitions_for(df.sparkSession, df.count() * ROW_BYTES)
    ranged = df.withColumn("__key", group).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())

    def count(batches):
        last, held = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("__key").to_numpy()
            starts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
            sizes = np.diff(np.r_[starts, len(keys)])
            local = ragged(sizes)
            if keys[0] == last:
                local[: sizes[0]] += held
            last, held = keys[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], [*b.schema.names, "__local"])

    counted = staged(ranged.mapInArrow(count, StructType([*ranged.schema, StructField("__local", LongType())])))
    per_part = counted.groupBy("__key", "__part").agg((F.max("__local") + 1).alias("n"))
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("__key", "__part", F.sum("n").over(before).alias("__base")).where("__base > 0")
    out = counted.join(F.broadcast(bases), ["__key", "__part"], "left")
    return out.select(*df.columns, (F.col("__local") + F.coalesce("__base", F.lit(0))).alias("place"))
