"""Queries over candles, and the indicators and labels made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..validate import interval as valid_interval
from ..validate import number, unique
from .core import between, latest, newest, time_range

COLUMNS = "open_time open high low close volume close_time quote_asset_volume trade_count taker_buy_base_asset_volume taker_buy_quote_asset_volume dataset source market symbol interval".split()
#: Candles read beyond those asked for, so that recursive indicators settle.
WARMUP = 60


def candles(df: DataFrame, start=None, end=None, limit: int = 500, keys: Sequence[str] = ("open_time",), ties: Sequence[str] = ("market", "source")) -> DataFrame:
    """The newest candles, one per open_time: what was imported last wins, whatever its market. Name more keys
    to keep markets apart."""
    return newest(latest(between(df, "open_time", start, end), keys, ties).select(*COLUMNS), "open_time", limit, [k for k in keys if k != "open_time"])


def candle_range(df: DataFrame, keys: Sequence[str] = ("open_time",), groups: Sequence[str] = ()) -> DataFrame:
    return time_range(latest(df, keys), "open_time", groups)


def recent(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Each group's newest n candles as one array in time order: at most n + WARMUP structs a group."""
    number(n, "limit", integer=True, minimum=1)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("open_time")))
    some = df.withColumn("__k", rank).where(F.col("__k") <= n + WARMUP)
    return some.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("open_time", "high", "low", "close", "close_time"))).alias("c"))


def indicator_frame(df: DataFrame, by: Sequence[str] = ("market", "symbol"), limit: int = 500) -> DataFrame:
    """All indicators of each group's newest candles, their status, and the latest close."""
    base = recent(df, by, limit).withColumn("close_values", F.transform("c", lambda x: x["close"]))
    close, n = F.col("close_values"), F.size("c")
    return base.select(
        *by,
        n.alias("candle_count"),
        F.least(F.greatest(n - limit, F.lit(0)), F.lit(WARMUP)).alias("warmup_candles"),
        F.element_at(close, -1).alias("latest_close"),
        F.element_at("c", -1)["close_time"].alias("latest_close_time"),
        I.sma(close, 20).alias("sma20"),
        I.ema(close, 20).alias("ema20"),
        I.rsi(close, 14).alias("rsi14"),
        I.macd(close).alias("macd"),
        I.bollinger(close).alias("bollinger20"),
        I.atr(F.col("c"), 14).alias("atr14"),
        F.struct(*[I.status(name, n).alias(name) for name in I.NEEDS]).alias("status"),
    )


def trend_label(close: Column, ema: Column) -> Column:
    """Equal counts as down."""
    return F.when(ema.isNull() | close.isNull(), "insufficient_data").when(close > ema, "uptrend").otherwise("downtrend")


def momentum_label(rsi: Column) -> Column:
    return F.when(rsi.isNull(), "unknown").when(rsi >= 70, "overbought").when(rsi <= 30, "oversold").otherwise("neutral")


def trends(df: DataFrame, by: Sequence[str] = ("market", "symbol"), limit: int = 500) -> DataFrame:
    out = indicator_frame(df, by, limit)
    return out.select(*by, "latest_close", "latest_close_time", "ema20", "rsi14", trend_label(F.col("latest_close"), F.col("ema20")).alias("trend"), momentum_label(F.col("rsi14")).alias("momentum"))


def alignment(up: Column, known: Column) -> Column:
    """How far a set of trends agrees; those without data have no vote."""
    return F.when(known == 0, "insufficient_data").when(up == known, "bullish_aligned").when(up == 0, "bearish_aligned").otherwise("mixed")


def multi_timeframe(df: DataFrame, intervals: Sequence[str] = ("1h", "4h", "1d"), by: Sequence[str] = ("market", "symbol"), limit: int = 500) -> DataFrame:
    """One row per group: the trend of each interval, their alignment, and the latest close time."""
    unique([valid_interval(i) for i in intervals], "intervals", 2, 5)
    each = trends(df.where(F.col("interval").isin(*intervals)), (*by, "interval"), limit)
    votes = each.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("interval", "trend"))).alias("trends"),
        F.count_if(F.col("trend") == "uptrend").alias("up"),
        F.count_if(F.col("trend") != "insufficient_data").alias("known"),
        F.max("latest_close_time").alias("data_time"),
    )
    return votes.select(*by, "trends", alignment(F.col("up"), F.col("known")).alias("alignment"), "data_time")
