"""Queries over snapshot series: open-interest metrics and book depth."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import bucket_start
from ..validate import series_filters
from .core import between, latest, newest, time_range


@dataclass(frozen=True)
class SeriesSpec:
    dataset: str
    keys: tuple[str, ...]
    values: tuple[str, ...]

    @property
    def all_keys(self) -> tuple[str, ...]:
        return "market", "symbol", "event_time", *self.keys


METRICS = SeriesSpec(
    "metrics",
    (),
    ("sum_open_interest", "sum_open_interest_value", "count_toptrader_long_short_ratio", "sum_toptrader_long_short_ratio", "count_long_short_ratio", "sum_taker_long_short_vol_ratio"),
)
BOOKDEPTH = SeriesSpec("bookdepth", ("percentage",), ("depth", "notional"))


def scoped(series: DataFrame, spec: SeriesSpec, start=None, end=None, percentage=None, by: str = "imported_at") -> DataFrame:
    df = between(series, "event_time", start, end)
    if percentage is not None:
        df = df.where(F.col("percentage") == percentage)
    return latest(df, spec.all_keys, spec.values, by)


def series_rows(series: DataFrame, spec: SeriesSpec, limit: int = 500, by: str = "imported_at", **scope) -> DataFrame:
    """The newest snapshots."""
    series_filters(spec.dataset, scope.get("percentage"))
    df = scoped(series, spec, by=by, **scope).select("event_time", *spec.keys, *spec.values, "dataset", "source", "market", "symbol")
    return newest(df, "event_time", limit, ("market", "symbol", *spec.keys))


def series_buckets(series: DataFrame, spec: SeriesSpec, bucket_seconds: int, groups: Sequence[str] = ("market", "symbol"), by: str = "imported_at", **scope) -> DataFrame:
    """Mean, least, greatest and last value of each value column, by bucket and the spec's own keys. Nulls are no
    values: the last is the last one there is."""
    series_filters(spec.dataset, scope.get("percentage"), bucket_seconds)
    df = scoped(series, spec, by=by, **scope).withColumn("bucket_start", bucket_start(F.col("event_time"), bucket_seconds))
    made = []
    for v in spec.values:
        made += [F.avg(v).alias(f"{v}_avg"), F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
        made.append(F.max_by(v, F.when(F.col(v).isNotNull(), F.col("event_time"))).alias(f"{v}_last"))
    return df.groupBy(*groups, "bucket_start", *spec.keys).agg(*made)


def series_range(series: DataFrame, spec: SeriesSpec, groups: Sequence[str] = (), by: str = "imported_at") -> DataFrame:
    return time_range(latest(series, spec.all_keys, spec.values, by), "event_time", groups)
