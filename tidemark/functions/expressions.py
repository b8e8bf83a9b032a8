"""Scalar expressions as Columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sub-month buckets are counted from this second (a Monday), not from 1970.
BUCKET_ORIGIN = 946857600
#: Epoch numbers from here on are microseconds, below it milliseconds.
MICROS_FROM = 100_000_000_000_000


def epoch_to_utc(c: Column) -> Column:
    """Epoch milliseconds or microseconds as a naive UTC timestamp, in integers throughout."""
    return F.timestamp_micros(F.when(F.abs(c) >= MICROS_FROM, c).otherwise(c * 1000)).cast("timestamp_ntz")


def text_to_bool(c: Column) -> Column:
    """true/1 and false/0 in any case; null for all else."""
    low = F.lower(c)
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def text_to_utc(c: Column) -> Column:
    return F.to_timestamp_ntz(c)


def bound_to_utc(text: str) -> Column:
    """An ISO time with an offset as naive UTC; the session's time zone must be UTC."""
    return F.lit(text).cast("timestamp").cast("timestamp_ntz")


def bucket_start(ts: Column, seconds: int) -> Column:
    return F.window(ts, f"{seconds} seconds", f"{seconds} seconds", f"{BUCKET_ORIGIN % seconds} seconds")["start"].cast("timestamp_ntz")


def span(first: Column, last: Column) -> Column:
    """Trades that an aggregate trade joins."""
    return last - first + 1


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return x / F.nullif(y, F.lit(0).cast("double"))


def is_sell(maker: Column) -> Column:
    """The taker sold if the buyer was the maker; an unknown side counts as a buy."""
    return F.coalesce(maker, F.lit(False))


def taker_buy(maker: Column, qty: Column) -> Column:
    return F.when(is_sell(maker), 0.0).otherwise(qty)


def taker_sell(maker: Column, qty: Column) -> Column:
    return F.when(is_sell(maker), qty).otherwise(0.0)


def signed(maker: Column, qty: Column) -> Column:
    return F.when(is_sell(maker), -qty).otherwise(qty)


def round8(c: Column) -> Column:
    return F.round(c, 8)


def sql_round(c: Column, digits: int) -> Column:
    """Rounded as SQL engines round a double: half away from zero of the double times a power of ten. Spark's round goes
    by the shortest decimal text, so the two differ where a product ends at a half that the text just misses."""
    scaled = c * 10.0**digits
    near = F.rint(scaled)
    whole = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near)
    return F.when(F.abs(scaled) < float("inf"), whole / 10.0**digits + 0.0).otherwise(c)


def between_values(low: Column, high: Column, share: Column) -> Column:
    """low * (1 - share) + high * share in DuckDB's last bit, which joins the first product and the sum in one rounding.
    None may be null."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - share, high * share).cast("double")


def basis_percent(mark: Column, index: Column) -> Column:
    return ratio(mark - index, index) * 100


def funding_percent(rate: Column) -> Column:
    return rate * 100


def spread_percent(bid: Column, ask: Column) -> Column:
    """Of the best ask."""
    return ratio(ask - bid, ask) * 100


def bid_share(bid_notional: Column, ask_notional: Column) -> Column:
    """The bids' share of both sides, from 0 to 1."""
    return ratio(bid_notional, bid_notional + ask_notional)


def notional(levels: Column) -> Column:
    """Sum of price * qty over an array of levels."""
    return F.aggregate(levels, F.lit(0.0), lambda a, x: a + x["price"] * x["qty"])


def normal_symbol(c: Column) -> Column:
    """Trimmed and upper-cased; null if it is no symbol."""
    up = F.upper(F.trim(c))
    return F.when(up.rlike("^[A-Z0-9]{5,30}$"), up)


def utc_second(c: Column) -> Column:
    return F.date_trunc("second", c).cast("timestamp_ntz")


def utc_day(c: Column) -> Column:
    return F.to_date(c)


def day_count(first: Column, last: Column) -> Column:
    """Days from first to last, both included; 0 where they are missing or out of order."""
    return F.greatest(F.coalesce(F.datediff(last, first) + 1, F.lit(0)), F.lit(0)).cast("long")


def finite(c: Column) -> Column:
    """Text as a finite double; anything else is an error."""
    x = c.try_cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a finite number: "), F.coalesce(c.cast("string"), F.lit("null"))))).otherwise(x)


def rescaled_ratio(r: Column) -> Column:
    """A buy/sell ratio as a signed share: (r - 1) / (r + 1)."""
    return ratio(r - 1, r + 1)
