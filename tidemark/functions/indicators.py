"""Technical indicators as folds over an array of candles in time order (structs with high, low, close).

Each gives the latest value, or null where the input is too short. RSI, MACD, Bollinger bands and ATR have eight
decimals; the averages have all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import round8


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _mean(values: Column, n: int) -> Column:
    return _total(values) / n


def _rest(values: Column, n: int) -> Column:
    """Everything after the first n."""
    return F.slice(values, n + 1, F.greatest(F.size(values) - n, F.lit(0)))


def _last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def sma(values: Column, n: int) -> Column:
    return F.when(F.size(values) >= n, _mean(_last(values, n), n))


def ema(values: Column, n: int) -> Column:
    """Seeded by the mean of the first n, then weighted 2 / (n + 1)."""
    k = 2.0 / (n + 1)
    return F.when(F.size(values) >= n, F.aggregate(_rest(values, n), _mean(F.slice(values, 1, n), n), lambda a, x: x * k + a * (1 - k)))


def wilder(values: Column, n: int) -> Column:
    """Seeded by the mean of the first n, then (a * (n - 1) + x) / n."""
    return F.aggregate(_rest(values, n), _mean(F.slice(values, 1, n), n), lambda a, x: (a * (n - 1) + x) / n)


def _pairs(values: Column) -> Column:
    """Each item but the first with the one before it."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.arrays_zip(F.slice(values, 1, n).alias("before"), F.slice(values, 2, n).alias("now"))


def rsi(values: Column, n: int) -> Column:
    """50 for a series without any change, 100 without any loss."""
    steps = F.transform(_pairs(values), lambda p: p["now"] - p["before"])
    gain = wilder(F.transform(steps, lambda d: F.greatest(d, F.lit(0.0))), n)
    loss = wilder(F.transform(steps, lambda d: F.greatest(-d, F.lit(0.0))), n)
    value = F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    return F.when(F.size(values) >= n + 1, round8(value))


def macd(values: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """(line, signal, histogram): the signal is an EMA of the line, which begins with the slow EMA. One pass."""
    kf, ks, kg = 2.0 / (fast + 1), 2.0 / (slow + 1), 2.0 / (signal + 1)
    start = F.struct(
        F.aggregate(F.slice(values, fast + 1, slow - fast), _mean(F.slice(values, 1, fast), fast), lambda a, x: x * kf + a * (1 - kf)).alias("f"),
        _mean(F.slice(values, 1, slow), slow).alias("s"),
    )
    start = F.struct(start["f"].alias("f"), start["s"].alias("s"), F.lit(1).alias("n"), (start["f"] - start["s"]).alias("g"))

    def step(a: Column, x: Column) -> Column:
        f, s, n = x * kf + a["f"] * (1 - kf), x * ks + a["s"] * (1 - ks), a["n"] + 1
        line = f - s
        # Until there are `signal` lines, g is their sum; then it is the EMA.
        g = F.when(n < signal, a["g"] + line).when(n == signal, (a["g"] + line) / signal).otherwise(line * kg + a["g"] * (1 - kg))
        return F.struct(f.alias("f"), s.alias("s"), n.alias("n"), g.alias("g"))

    def end(a: Column) -> Column:
        line = a["f"] - a["s"]
        return F.struct(round8(line).alias("line"), round8(a["g"]).alias("signal"), round8(line - a["g"]).alias("histogram"))

    return F.when(F.size(values) >= slow + signal - 1, F.aggregate(_rest(values, slow), start, step, end))


def bollinger(values: Column, n: int = 20, width: float = 2.0) -> Column:
    """(upper, middle, lower) from the last n and their population deviation."""
    last = _last(values, n)
    mean = _mean(last, n)
    deviation = F.sqrt(F.aggregate(last, F.struct(F.lit(0.0).alias("q"), mean.alias("m")), lambda a, x: F.struct((a["q"] + (x - a["m"]) * (x - a["m"])).alias("q"), a["m"].alias("m")))["q"] / n)
    return F.when(F.size(values) >= n, F.struct(round8(mean + width * deviation).alias("upper"), round8(mean).alias("middle"), round8(mean - width * deviation).alias("lower")))


def atr(candles: Column, n: int) -> Column:
    """Wilder's average of true ranges, which need the close before."""
    ranges = F.transform(
        _pairs(candles),
        lambda p: F.greatest(p["now"]["high"] - p["now"]["low"], F.abs(p["now"]["high"] - p["before"]["close"]), F.abs(p["now"]["low"] - p["before"]["close"])),
    )
    return F.when(F.size(candles) >= n + 1, round8(wilder(ranges, n)))


#: Candles that each indicator needs.
NEEDS = {"sma20": 20, "ema20": 20, "rsi14": 15, "macd": 34, "bollinger20": 20, "atr14": 15}


def status(name: str, n: Column) -> Column:
    """ok, degraded (an EMA that is its seed alone) or insufficient_data."""
    short = F.when(n < NEEDS[name], "insufficient_data")
    return (short.when(n == NEEDS[name], "degraded") if name == "ema20" else short).otherwise("ok")
