"""Questions that the import catalog answers without reading data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import bound_to_utc, day_count, utc_day, utc_second
from ..validate import need, number

LISTED_DAYS = 800
LABELS = ("dataset", "source", "profile", "market", "symbol", "interval")


def selected(files: DataFrame, **labels: str | None) -> DataFrame:
    for name, value in labels.items():
        need(name in LABELS, f"{name}: not a label")
        if value is not None:
            files = files.where(F.col(name) == value)
    return files


def overlapping(files: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Files whose times may touch the window: bounds are cut to seconds, which only widens; no bound is a maybe."""
    if start is not None:
        files = files.where(F.col("max_event_time").isNull() | (utc_second(F.col("max_event_time")) >= utc_second(bound_to_utc(start))))
    if end is not None:
        files = files.where(F.col("min_event_time").isNull() | (utc_second(F.col("min_event_time")) <= utc_second(bound_to_utc(end))))
    return files


def list_datasets(files: DataFrame) -> DataFrame:
    return files.groupBy(*LABELS).agg(F.count("*").alias("file_count"), F.sum("row_count").alias("row_count"), F.min("min_event_time").alias("min_event_time"), F.max("max_event_time").alias("max_event_time"))


def list_files(files: DataFrame, limit: int = 100, **labels: str | None) -> DataFrame:
    number(limit, "limit", integer=True, minimum=1)
    need(limit <= 1000, "limit: at most 1000")
    return selected(files, **labels).orderBy(F.desc("created_at"), "path").limit(limit)


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("job_count"))


def totals(files: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("row_count"), zero).alias("row_count"), F.coalesce(F.sum("file_size_bytes"), zero).alias("byte_count"))


def covered_days(files: DataFrame) -> DataFrame:
    """Distinct days between the bounds of each file."""
    known = files.where("min_event_time is not null and max_event_time is not null")
    first, last = utc_day(F.col("min_event_time")), utc_day(F.col("max_event_time"))
    return known.where(first <= last).select(F.explode(F.sequence(first, last)).alias("day")).distinct()


def coverage_levels(files: DataFrame, levels: Sequence[str] = ("dataset", "market", "symbol")) -> DataFrame:
    """For each level and for all: file_count, row_count, bytes, and day_count, the distinct days between the bounds of any
    of its files. `depth` says how many of the levels a row is of; labels that are null are groups of their own. One
    expansion of the catalog for all levels; a day is counted once before it is sent, so no level's days meet as rows."""
    first, last = utc_day(F.col("min_event_time")), utc_day(F.col("max_event_time"))
    days = F.when(first <= last, F.sequence(first, last))
    each = files.select(*levels, "row_count", "file_size_bytes", F.posexplode_outer(days).alias("nth", "day"))
    own = F.coalesce(F.col("nth"), F.lit(0)) == 0
    once = lambda c: F.coalesce(F.sum(F.when(own, F.col(c))), F.lit(0)).alias(c)
    out = each.rollup(*levels).agg(
        F.count_if(own).alias("file_count"), once("row_count"), once("file_size_bytes"), F.count_distinct("day").alias("day_count"), (len(levels) - F.bit_count(F.grouping_id())).cast("int").alias("depth")
    )
    return out.select("depth", *levels, "file_count", "row_count", F.col("file_size_bytes").alias("byte_count"), "day_count")


def _expected(days: DataFrame, start: str | None, end: str | None) -> DataFrame:
    ends = days.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return ends.select("first", "last", (utc_day(bound_to_utc(start)) if start else F.col("first")).alias("from"), (utc_day(bound_to_utc(end)) if end else F.col("last")).alias("to"))


def missing_days(files: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """All expected days that no file covers; without a window, those between the first and the last covered."""
    days = covered_days(overlapping(files, start, end))
    span = _expected(days, start, end).where(F.col("from") <= F.col("to"))
    return span.select(F.explode(F.sequence("from", "to")).alias("day")).join(days, "day", "left_anti")


def coverage(files: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row: exact counts, and lists of at most LISTED_DAYS days with a flag where they are cut."""
    days = covered_days(overlapping(files, start, end))

    def listed(d: DataFrame, name: str) -> DataFrame:
        rank = F.row_number().over(Window.orderBy("day"))
        some = d.withColumn("k", rank)
        kept = F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= LISTED_DAYS, F.col("day")))), lambda x: x.cast("string"))
        return some.agg(F.count("*").alias(f"{name}_day_count"), kept.alias(f"{name}_days"))

    out = listed(days, "covered").crossJoin(listed(missing_days(files, start, end), "missing")).crossJoin(_expected(days, start, end))  # each is one row
    return out.select(
        "covered_day_count",
        F.col("first").alias("first_day"),
        F.col("last").alias("last_day"),
        day_count(F.col("from"), F.col("to")).alias("expected_day_count"),
        "missing_days",
        "missing_day_count",
        (F.col("missing_day_count") > LISTED_DAYS).alias("truncated"),
        "covered_days",
        (F.col("covered_day_count") > LISTED_DAYS).alias("covered_days_truncated"),
    )
