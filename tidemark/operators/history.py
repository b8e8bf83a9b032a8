"""Indicators and flow at every candle or trade of a history, however long one symbol's is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import signed
from .core import latest
from .scan import affine_scan, numbered, running_total, with_halo
from .tape import ID, TIES, keys


def trade_delta(tape: DataFrame, dataset: str, by: Sequence[str] = ("market", "symbol")) -> DataFrame:
    """The latest revision of each trade with the taker delta up to and with it, in order of time, then id."""
    df = latest(tape, keys(dataset), TIES).withColumn("signed_qty", signed(F.col("is_buyer_maker"), F.col("qty")))
    return running_total(df, "signed_qty", by, [F.col("event_time"), F.col(ID[dataset])], "cvd")


def seeded(x: Column, at: Column, n: int, weight: float) -> tuple[Column, Column]:
    """The recursion whose value at place n - 1 is the mean of the first n and which goes on by weight."""
    first = at < n
    return F.when(first, 1.0).otherwise(1 - weight), F.when(at < 0, 0.0).when(first, x / n).otherwise(x * weight)


def indicator_history(candles: DataFrame, by: Sequence[str] = ("market", "symbol"), time: str = "open_time") -> DataFrame:
    """by, time, close and at every candle: sma20, ema20, rsi14, macd_line, macd_signal, macd_histogram, upper_band, middle_band,
    lower_band and atr14; null where there are too few candles before, as in indicators of the latest candle, but with all decimals.

    Candles are one per group and time, with high, low and close; time and prices are not null. Averages of the last
    20 candles see 19 of the block before; recursions go through blocks as affine maps. Four shuffles of the
    candles' few columns, none of them by group alone.
    """
    rows = numbered(candles.select(*by, time, "high", "low", F.col("close").cast("double").alias("close")), by, [F.col(time)], "__nth")
    rows = with_halo(rows, "__nth", 19)
    w = Window.partitionBy(*by, "__block").orderBy("__nth")
    last20, nth = w.rowsBetween(-19, 0), F.col("__nth")
    full = nth >= 19
    rows = rows.withColumns({"__before": F.lag("close").over(w), "__mean": F.avg("close").over(last20), "__dev": F.stddev_pop("close").over(last20)}).where("__own")
    # A group's first candle has none before it; its step counts for nothing.
    change = F.coalesce(F.col("close") - F.col("__before"), F.lit(0.0))
    ranges = F.coalesce(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__before")), F.abs(F.col("low") - F.col("__before"))), F.lit(0.0))
    close, step = F.col("close"), nth - 1
    ema = lambda n: seeded(close, nth, n, 2 / (n + 1))
    wilder = lambda x: seeded(x, step, 14, 1 / 14)
    rows = affine_scan(rows, by, "__nth", {"ema20": ema(20), "__fast": ema(12), "__slow": ema(26), "__gain": wilder(F.greatest(change, F.lit(0.0))), "__loss": wilder(F.greatest(-change, F.lit(0.0))), "__range": wilder(ranges)})
    # The signal is an average of lines, of which the slow average's 26th candle has the first.
    line = F.col("__fast") - F.col("__slow")
    rows = affine_scan(rows, by, "__nth", {"__signal": seeded(line, nth - 25, 9, 2 / 10)})
    gain, loss = F.col("__gain"), F.col("__loss")
    rsi = F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    signal, mean, dev = F.col("__signal"), F.col("__mean"), F.col("__dev")
    made = {
        "sma20": F.when(full, mean),
        "ema20": F.when(full, F.col("ema20")),
        "rsi14": F.when(nth >= 14, rsi),
        "macd_line": F.when(nth >= 33, line),
        "macd_signal": F.when(nth >= 33, signal),
        "macd_histogram": F.when(nth >= 33, line - signal),
        "upper_band": F.when(full, mean + 2 * dev),
        "middle_band": F.when(full, mean),
        "lower_band": F.when(full, mean - 2 * dev),
        "atr14": F.when(nth >= 14, F.col("__range")),
    }
    return rows.select(*by, time, "close", *[c.alias(k) for k, c in made.items()])
