"""Snapshots: tickers, order books, mark prices, funding and the combined futures report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import basis_percent, bid_share, funding_percent, notional, spread_percent
from ..validate import unique
from .candles import trend_label

OVERVIEW_ROWS = 30


def overview(tickers: DataFrame, quote: str = "USDT", n: int = OVERVIEW_ROWS) -> DataFrame:
    """The n markets in a quote currency with the greatest quote volume."""
    return tickers.where(F.col("symbol").endswith(quote)).orderBy(F.desc_nulls_last("quote_volume"), "symbol").limit(n)


def compare(tickers: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """2 to 20 markets by quote volume; unknown ones are left out."""
    return tickers.where(F.col("symbol").isin(*unique(list(symbols), "symbols", 2, 20))).orderBy(F.desc_nulls_last("quote_volume"), "symbol")


def order_book_summary(books: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Best prices, spread and imbalance of books with arrays bids and asks of (price, qty), best first. An empty
    side is an error when it runs."""
    empty = F.raise_error(F.lit("the order book has an empty side"))
    full = F.when((F.size("bids") > 0) & (F.size("asks") > 0), True).otherwise(empty.cast("boolean"))
    bid, ask = F.get("bids", F.lit(0))["price"], F.get("asks", F.lit(0))["price"]
    bids, asks = notional(F.col("bids")), notional(F.col("asks"))
    return books.where(full).select(
        *by,
        bid.alias("best_bid"),
        ask.alias("best_ask"),
        (ask - bid).alias("spread"),
        spread_percent(bid, ask).alias("spread_percent"),
        bids.alias("bid_notional"),
        asks.alias("ask_notional"),
        bid_share(bids, asks).alias("bid_ask_imbalance"),
    )


def mark_price(premium: DataFrame) -> DataFrame:
    return premium.select(
        "symbol", "mark_price", "index_price", "last_funding_rate", basis_percent(F.col("mark_price"), F.col("index_price")).alias("basis_percent"), funding_percent(F.col("last_funding_rate")).alias("funding_rate_percent")
    )


def funding_history(funding: DataFrame) -> DataFrame:
    return funding.withColumn("funding_rate_percent", funding_percent(F.col("funding_rate")))


def futures_report(trend: DataFrame, tickers: DataFrame, premium: DataFrame, interest: DataFrame) -> DataFrame:
    """One row per symbol that all four have: trend (no momentum), ticker, mark price and open interest."""
    t = trend.select("symbol", "latest_close", "ema20", trend_label(F.col("latest_close"), F.col("ema20")).alias("trend"))
    return t.join(tickers, "symbol").join(mark_price(premium), "symbol").join(interest, "symbol")


def books_from_levels(levels: DataFrame, by: Sequence[str], depth: int) -> DataFrame:
    """Books of at most depth levels a side, best first, from rows (side, price, qty)."""
    out = None
    for side, order in (("bid", F.desc("price")), ("ask", F.asc("price"))):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, F.desc("qty")))
        best = levels.where(F.col("side") == side).withColumn("k", rank).where(F.col("k") <= depth)
        array = best.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "price", "qty"))), lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty"))).alias(f"{side}s"))
        out = array if out is None else out.join(array, list(by))
    return out
