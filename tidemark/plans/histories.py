"""Queries over whole histories: the row in force at each trade, running sums and indicators at every row, and a
stream that corrects its buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow, history, tape
from ..operators.core import latest
from ..operators.scan import asof_join
from ..sources.shared import shared_folder
from ..streaming.revisions import RevisedBuckets
from . import views as V
from .registry import register

W = V.with_views
HOT_SQL = "CASE WHEN {0} % 10 <> 0 THEN 'HOTUSDT' ELSE 'S' || CAST({0} // 10 % 5 AS VARCHAR) || 'USDT' END"


def hot(key: str):
    """Nine in ten rows are of one symbol."""
    return F.when(F.col(key) % 10 != 0, "HOTUSDT").otherwise(F.concat(F.lit("S"), F.expr(f"{key} div 10 % 5"), F.lit("USDT")))


SNAPSHOTS = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, taken_at ORDER BY imported_at DESC) AS rn FROM (SELECT TIMESTAMP '2024-01-01' + to_seconds((o_orderkey * 977) % 2592000) AS taken_at, {HOT_SQL.format('o_orderkey')} AS symbol, o_totalprice AS open_interest, o_orderkey AS imported_at FROM orders) AS x) AS y WHERE rn = 1"


@register(
    "t8_interest_at_trades",
    W(["tape"], "SELECT t.market, t.trade_id, t.symbol, t.event_time, t.price, s.taken_at, s.open_interest FROM t ASOF LEFT JOIN s ON t.symbol = s.symbol AND t.event_time >= s.taken_at", {"t": f"SELECT * REPLACE ({HOT_SQL.format('trade_id')} AS symbol) FROM tape", "s": SNAPSHOTS}),
    "price open_interest",
)
def _(spark, d):
    trades = latest(V.tape_raw(spark, d), tape.keys("trades")).withColumn("symbol", hot("trade_id")).select("market", "trade_id", "symbol", "event_time", "price")
    o = V.table(spark, d, "orders")
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("o_orderkey") * 977) % 2592000)
    snapshots = o.select(at.alias("taken_at"), hot("o_orderkey").alias("symbol"), F.col("o_totalprice").alias("open_interest"), F.col("o_orderkey").alias("imported_at"))
    return asof_join(trades, snapshots, ["symbol"], "event_time", "taken_at", ties=["imported_at"]).drop("imported_at")


@register("w2_delta_of_trades", W(["tape"], "SELECT market, trade_id, event_time, sum(CASE WHEN is_buyer_maker THEN -qty ELSE qty END) OVER (PARTITION BY market ORDER BY event_time, trade_id ROWS UNBOUNDED PRECEDING) AS cvd FROM tape"), "cvd")
def _(spark, d):
    return history.trade_delta(V.tape_raw(spark, d), "trades", ["market"]).select("market", "trade_id", "event_time", "cvd")


LARGE = "SELECT 'HOT' AS market, CAST(NULL AS VARCHAR) AS symbol, event_time, price * qty AS notional, span FROM agg WHERE price * qty >= 1000"


@register(
    "t5_sweep_sessions",
    W(["agg"], """SELECT market, symbol, session, min(event_time) AS first_event_time, max(event_time) AS last_event_time, count(*) AS trade_count, count(*) FILTER (WHERE span > 50) AS sweep_count, sum(notional) AS notional FROM (
 SELECT *, CAST(sum(CASE WHEN event_time > before + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (ORDER BY event_time) AS BIGINT) + 1 AS session FROM (SELECT *, lag(event_time) OVER (ORDER BY event_time) AS before FROM l) AS x) AS y GROUP BY market, symbol, session""", {"l": LARGE}),
    "notional",
)
def _(spark, d):
    """All trades as those of one symbol, whose name is not known."""
    df = latest(V.agg_raw(spark, d), tape.keys("aggtrades")).withColumns({"market": F.lit("HOT"), "symbol": F.lit(None).cast("string")})
    return flow.sweep_sessions(df, 600, 1000, 50)


ONE = "SELECT *, row_number() OVER (PARTITION BY market ORDER BY open_time) AS i, lag(close) OVER (PARTITION BY market ORDER BY open_time) AS before FROM k"
#: Each recursion is a sum of shares of the first n, then weighted; a line is there from the 26th candle on.
_STEP = "CASE WHEN {i} < 1 THEN 0 WHEN {i} <= {n} THEN {y} + {x} / {n} ELSE {y} * (1 - {w}) + {x} * {w} END"


def _step(y: str, x: str, n: int, w: str, i: str = "c.i") -> str:
    return _STEP.format(y=f"r.{y}", x=x, n=n, w=f"({w})", i=i)


_GAIN, _LOSS = "greatest(c.close - c.before, 0)", "greatest(c.before - c.close, 0)"
_RANGE = "greatest(c.high - c.low, abs(c.high - c.before), abs(c.low - c.before))"
RECURSION = f"""SELECT DISTINCT market, CAST(0 AS BIGINT) AS i, 0.0::DOUBLE AS e, 0.0::DOUBLE AS f, 0.0::DOUBLE AS s, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l, 0.0::DOUBLE AS a, 0.0::DOUBLE AS m FROM c
 UNION ALL SELECT market, i, e, f, s, g, l, a, {_STEP.format(i='i - 25', n=9, y='m', x='(f - s)', w='0.2')} FROM (SELECT c.market, c.i, {_step('e', 'c.close', 20, '2.0 / 21')} AS e, {_step('f', 'c.close', 12, '2.0 / 13')} AS f, {_step('s', 'c.close', 26, '2.0 / 27')} AS s,
 {_step('g', _GAIN, 14, '1.0 / 14', 'c.i - 1')} AS g, {_step('l', _LOSS, 14, '1.0 / 14', 'c.i - 1')} AS l, {_step('a', _RANGE, 14, '1.0 / 14', 'c.i - 1')} AS a, r.m FROM r JOIN c ON c.market = r.market AND c.i = r.i + 1) AS x"""
EVERY = """SELECT c.market, open_time, close, CASE WHEN c.i >= 20 THEN avg(close) OVER w END AS sma20, CASE WHEN c.i >= 20 THEN e END AS ema20, CASE WHEN c.i < 15 THEN NULL WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi14,
 CASE WHEN c.i >= 34 THEN f - s END AS macd_line, CASE WHEN c.i >= 34 THEN m END AS macd_signal, CASE WHEN c.i >= 34 THEN f - s - m END AS macd_histogram, CASE WHEN c.i >= 20 THEN avg(close) OVER w + 2 * stddev_pop(close) OVER w END AS upper_band,
 CASE WHEN c.i >= 20 THEN avg(close) OVER w END AS middle_band, CASE WHEN c.i >= 20 THEN avg(close) OVER w - 2 * stddev_pop(close) OVER w END AS lower_band, CASE WHEN c.i >= 15 THEN a END AS atr14
 FROM c JOIN r ON r.market = c.market AND r.i = c.i WINDOW w AS (PARTITION BY c.market ORDER BY c.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


@register(
    "i_every_candle",
    W(["tape"], EVERY, {"k": V.candle_sql(900, "15m").replace("FROM tape)", "FROM (SELECT * REPLACE ('ALLUSDT' AS symbol) FROM tape) AS z)"), "c": ONE, "r": RECURSION}, recursive=True),
    "close sma20 ema20 rsi14 macd_line macd_signal macd_histogram upper_band middle_band lower_band atr14",
)
def _(spark, d):
    """All symbols of a market as one, so that its history is long."""
    bars = tape.to_candles(V.tape_raw(spark, d).withColumn("symbol", F.lit("ALLUSDT")), "trades", 900, "15m")
    return history.indicator_history(bars, ["market"])


MOVED = "SELECT * REPLACE (CASE WHEN imported_at = 2 AND trade_id % 2 = 0 THEN event_time + INTERVAL 3 DAY ELSE event_time END AS event_time) FROM tape_raw"


@register(
    "st1_revised_buckets",
    W(["tape_raw"], "SELECT market, symbol, bucket_start, trade_count, volume, quote_volume, taker_buy_volume, taker_sell_volume, open, close, high, low FROM b", {"moved": MOVED, "now": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, trade_id ORDER BY imported_at DESC) AS rn FROM moved) AS x WHERE rn = 1", "b": V.bucket_sql("now", 86400)}),
    "volume quote_volume taker_buy_volume taker_sell_volume open close high low",
)
def _(spark, d):
    """All trades through a stream, which then starts again and gets the republished ones, half of them at other times."""
    src = V.tape_raw(spark, d)
    move = (F.col("imported_at") == 2) & (F.col("trade_id") % 2 == 0)
    src = src.withColumn("event_time", F.when(move, F.col("event_time") + F.expr("interval 3 days")).otherwise(F.col("event_time")))
    source, checkpoint, out = shared_folder(spark), shared_folder(spark), RevisedBuckets(shared_folder(spark), "trades", 86400)
    for revision in (1, 2):
        src.where(F.col("imported_at") == revision).write.mode("append").parquet(source)
        query = out.start(spark.readStream.schema(src.schema).parquet(source), checkpoint, availableNow=True)
        query.awaitTermination()
    return out.buckets(spark).select("market", "symbol", "bucket_start", "trade_count", "volume", "quote_volume", "taker_buy_volume", "taker_sell_volume", "open", "close", "high", "low")
