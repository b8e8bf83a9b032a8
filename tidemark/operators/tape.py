"""Queries over trades and aggregate trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import BUCKET_ORIGIN, bucket_start, ratio, signed, span, taker_buy, taker_sell
from ..validate import tape_filters
from .core import between, latest, newest, running_sum, time_range

ID = {"trades": "trade_id", "aggtrades": "agg_trade_id"}
TIES = ("price", "qty")


def keys(dataset: str) -> tuple[str, str]:
    """Each market numbers its trades on its own."""
    return "market", ID[dataset]


def scoped(tape: DataFrame, dataset: str, start=None, end=None, min_price=None, max_price=None, min_notional=None, min_span=None) -> DataFrame:
    """Rows in the time and price bounds, then the latest revision of each trade. A revision outside the bounds
    is not seen, so an older one inside them stays."""
    df = between(tape, "event_time", start, end)
    if min_price is not None:
        df = df.where(F.col("price") >= min_price)
    if max_price is not None:
        df = df.where(F.col("price") <= max_price)
    if min_notional is not None:
        df = df.where(F.col("price") * F.col("qty") >= min_notional)
    if min_span is not None:
        df = df.where(span(F.col("first_trade_id"), F.col("last_trade_id")) >= min_span)
    return latest(df, keys(dataset), TIES)


def tape_rows(tape: DataFrame, dataset: str, limit: int = 500, **scope) -> DataFrame:
    """The newest trades; aggregate trades with their span."""
    tape_filters(dataset, "rows", **scope)
    df = scoped(tape, dataset, **scope)
    extra = [F.col("first_trade_id"), F.col("last_trade_id"), span(F.col("first_trade_id"), F.col("last_trade_id")).alias("span")] if dataset == "aggtrades" else []
    columns = [F.col(ID[dataset]), *extra, *map(F.col, ("price", "qty", "quote_qty", "event_time", "is_buyer_maker", "is_best_match", "dataset", "source", "market", "symbol"))]
    return newest(df.select(*columns), "event_time", limit, (ID[dataset], "market"))


def bucket_aggregates(dataset: str, floor: float = 0) -> list:
    value, maker, qty = F.col("price") * F.col("qty"), F.col("is_buyer_maker"), F.col("qty")
    # First and last are by time and then by id, so equal times do not leave them open.
    at = F.struct("event_time", ID[dataset])
    large = value >= floor
    return [
        F.count("*").alias("trade_count"),
        F.sum("qty").alias("volume"),
        F.sum(value).alias("quote_volume"),
        F.sum(taker_buy(maker, qty)).alias("taker_buy_volume"),
        F.sum(taker_sell(maker, qty)).alias("taker_sell_volume"),
        F.count_if(large).alias("large_trade_count"),
        F.sum(F.when(large, value)).alias("large_trade_notional"),
        F.min_by("price", at).alias("open"),
        F.max_by("price", at).alias("close"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
    ]


def tape_buckets(tape: DataFrame, dataset: str, bucket_seconds: int, min_notional: float | None = None, by: Sequence[str] = ("market", "symbol"), **scope) -> DataFrame:
    """Time buckets of the latest revisions: volumes, taker split and imbalance, large trades, prices and the
    running taker delta, which begins with the window. min_notional only says what a large trade is."""
    tape_filters(dataset, "buckets", bucket_seconds=bucket_seconds, min_notional=min_notional, **scope)
    df = scoped(tape, dataset, **scope).withColumn("bucket_start", bucket_start(F.col("event_time"), bucket_seconds))
    out = df.groupBy(*by, "bucket_start").agg(*bucket_aggregates(dataset, min_notional or 0))
    buy, sell = F.col("taker_buy_volume"), F.col("taker_sell_volume")
    out = out.withColumns({"vwap": ratio(F.col("quote_volume"), F.col("volume")), "taker_imbalance": ratio(buy - sell, buy + sell), "taker_delta": buy - sell})
    names = "trade_count volume quote_volume vwap taker_buy_volume taker_sell_volume taker_imbalance large_trade_count large_trade_notional open close high low taker_delta cvd"
    return running_sum(out, "taker_delta", "bucket_start", "cvd", by).select(*by, "bucket_start", *names.split())


def footprint(tape: DataFrame, dataset: str, bucket_seconds: int, start: str, end: str, by: Sequence[str] = ("market", "symbol"), **scope) -> DataFrame:
    """Buckets by price level."""
    tape_filters(dataset, "prices", start=start, end=end, bucket_seconds=bucket_seconds, **scope)
    df = scoped(tape, dataset, start=start, end=end, **scope).withColumn("bucket_start", bucket_start(F.col("event_time"), bucket_seconds))
    maker, qty = F.col("is_buyer_maker"), F.col("qty")
    return df.groupBy(*by, "bucket_start", "price").agg(
        F.sum(taker_buy(maker, qty)).alias("taker_buy_volume"),
        F.sum(taker_sell(maker, qty)).alias("taker_sell_volume"),
        F.sum(signed(maker, qty)).alias("delta"),
        F.sum("qty").alias("volume"),
        F.count("*").alias("trade_count"),
        F.min("event_time").alias("first_event_time"),
        F.max("event_time").alias("last_event_time"),
    )


def footprint_order() -> list:
    return [F.asc_nulls_last("bucket_start"), F.desc_nulls_last("volume"), F.asc_nulls_last("price")]


def tape_range(tape: DataFrame, dataset: str, by: Sequence[str] = ()) -> DataFrame:
    return time_range(latest(tape, keys(dataset), TIES), "event_time", by)


def to_candles(tape: DataFrame, dataset: str, bucket_seconds: int, interval: str) -> DataFrame:
    """Candles of a tape's latest revisions, in the candle schema."""
    df = scoped(tape, dataset).withColumn("open_time", bucket_start(F.col("event_time"), bucket_seconds))
    out = df.groupBy("source", "market", "symbol", "open_time").agg(*bucket_aggregates(dataset), F.sum(taker_buy(F.col("is_buyer_maker"), F.col("price") * F.col("qty"))).alias("taker_buy_quote_asset_volume"))
    return out.select(
        *["open_time", "open", "high", "low", "close", "volume"],
        (F.col("open_time") + F.make_dt_interval(secs=F.lit(bucket_seconds)) - F.make_dt_interval(secs=F.lit(0.001))).alias("close_time"),
        F.col("quote_volume").alias("quote_asset_volume"),
        "trade_count",
        F.col("taker_buy_volume").alias("taker_buy_base_asset_volume"),
        "taker_buy_quote_asset_volume",
        F.lit("klines").alias("dataset"),
        *["source", "market", "symbol"],
        F.lit(interval).alias("interval"),
    )


def widened(candles: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Candles of several intervals (names and seconds) from those of one that divides them all: one pass and one
    shuffle of the short candles, and none of the tape."""
    since = F.unix_seconds(F.col("open_time").cast("timestamp")) - BUCKET_ORIGIN
    at = lambda seconds: F.timestamp_seconds(since - F.pmod(since, F.lit(seconds)) + BUCKET_ORIGIN).cast("timestamp_ntz")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("interval"), at(s).alias("open_time"), F.lit(s).alias("seconds")) for name, s in widths.items()]))
    wide = candles.select("*", each.alias("w")).groupBy("source", "market", "symbol", "w")
    sums = ("volume", "quote_asset_volume", "trade_count", "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume")
    out = wide.agg(F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), *[F.sum(c).alias(c) for c in sums], F.first("dataset").alias("dataset"))
    end = F.col("w.open_time") + F.make_dt_interval(secs=F.col("w.seconds")) - F.make_dt_interval(secs=F.lit(0.001))
    made = {"open_time": F.col("w.open_time"), "close_time": end, "interval": F.col("w.interval")}
    return out.withColumns(made).select(*candles.columns)
