"""The shared shapes: latest revision of a key, newest rows, capped results, running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import bound_to_utc
from ..validate import limit as valid_limit


def latest(df: DataFrame, keys: Sequence[str], ties: Sequence[str] = (), by: str = "imported_at") -> DataFrame:
    """One row per key: the one imported last; equal ones are told apart by `ties`, the greatest first.

    Filters that come before stay before: a row that a filter has dropped cannot supersede another. The
    ranking keeps one row per key and task before the shuffle.
    """
    order = [F.desc_nulls_last(c) for c in (by, *ties)]
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def between(df: DataFrame, time: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from start to end, both included. Bounds are ISO texts with offsets."""
    if start is not None:
        df = df.where(F.col(time) >= bound_to_utc(start))
    if end is not None:
        df = df.where(F.col(time) <= bound_to_utc(end))
    return df


def newest(df: DataFrame, time: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(time), *[F.desc_nulls_last(c) for c in ties]).limit(valid_limit(n))


def capped(df: DataFrame, n: int, order: Sequence[Column], what: str = "rows") -> DataFrame:
    """df in order, or an error when it runs if it has more than n rows."""
    some = df.orderBy(*order).limit(valid_limit(n) + 1)
    counted = some.withColumn("__n", F.count("*").over(Window.partitionBy()))
    ok = F.when(F.col("__n") > n, F.raise_error(F.lit(f"the result has more than {n} {what}; narrow it or raise the limit")).cast("boolean")).otherwise(True)
    return counted.where(ok).drop("__n").orderBy(*order)


def running_sum(df: DataFrame, value: str, order: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """value summed from the first row to each row, over already aggregated rows."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)))


def time_range(df: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    """row_count, min_time and max_time; without `by`, one row even of an empty table."""
    return df.groupBy(*by).agg(F.count("*").alias("row_count"), F.min(time).alias("min_time"), F.max(time).alias("max_time"))


def changes(before: DataFrame, after: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """What became of rows: for each distinct one n_before and n_after, how often it is there, and of those times how many
    were removed, added and kept: EXCEPT ALL both ways and INTERSECT ALL in one pass. Nulls equal nulls.

    Rows are counted before the shuffle, so one that is repeated very often is one row of it a task.
    """
    columns = list(columns or before.columns)
    here, gone = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = before.select(*columns, here.alias("n_before"), gone.alias("n_after")).unionByName(after.select(*columns, gone.alias("n_before"), here.alias("n_after")))
    out = both.groupBy(*columns).agg(F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))
    b, a = F.col("n_before"), F.col("n_after")
    return out.withColumns({"n_removed": F.greatest(b - a, gone), "n_added": F.greatest(a - b, gone), "n_kept": F.least(b, a)})
