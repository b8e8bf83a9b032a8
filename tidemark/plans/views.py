"""Market-shaped views over the driver's tables, as DataFrames and, with the same formulas, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import market, tape
from ..operators.core import latest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trades; every seventh was published again a unit higher."""
    first = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trade_id"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").cast("double").alias("qty"),
        F.col("ts").alias("event_time"),
        F.col("event_type").isin("error", "purchase").alias("is_buyer_maker"),
        F.when(F.col("user_id") % 2 == 0, "spot").otherwise("um").alias("market"),
        F.concat(F.lit("S"), F.col("user_id") % 5, F.lit("USDT")).alias("symbol"),
        F.lit("trades").alias("dataset"),
        F.lit("driver").alias("source"),
        F.lit(1).alias("imported_at"),
    )
    first = first.withColumns({"quote_qty": F.col("price") * F.col("qty"), "is_best_match": F.lit(None).cast("boolean")})
    again = first.where("trade_id % 7 = 0").withColumns({"price": F.col("price") + 1, "imported_at": F.lit(2)})
    return first.unionByName(again)


def agg_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tape_raw(spark, sf_dir).withColumnRenamed("trade_id", "agg_trade_id")
    first = F.col("agg_trade_id") * 100
    return df.withColumns({"first_trade_id": first, "last_trade_id": first + F.col("qty").cast("bigint"), "quote_qty": F.lit(None).cast("double"), "dataset": F.lit("aggtrades")})


def candles_raw(spark: SparkSession, sf_dir: str, seconds: int, interval: str) -> DataFrame:
    return tape.to_candles(tape_raw(spark, sf_dir), "trades", seconds, interval).withColumn("imported_at", F.lit(1))


def metrics_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("event_time"),
        price.alias("sum_open_interest"),
        (price * 2).alias("sum_open_interest_value"),
        (F.col("o_custkey") % 7 + 1).cast("double").alias("count_toptrader_long_short_ratio"),
        (F.col("o_custkey") % 5 + 1).cast("double").alias("sum_toptrader_long_short_ratio"),
        F.when(F.col("o_custkey") % 3 != 0, (F.col("o_custkey") % 3).cast("double")).alias("count_long_short_ratio"),
        (F.col("o_custkey") % 11 + 1).cast("double").alias("sum_taker_long_short_vol_ratio"),
        F.lit("metrics").alias("dataset"),
        F.lit("driver").alias("source"),
        F.lit("um").alias("market"),
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderkey").alias("imported_at"),
    )


def bookdepth_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.round(F.col("l_discount") * 100).cast("int").cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("event_time"),
        F.when(F.col("l_linestatus") == "F", -band).otherwise(band).alias("percentage"),
        F.col("l_quantity").alias("depth"),
        F.col("l_extendedprice").alias("notional"),
        F.lit("bookdepth").alias("dataset"),
        F.lit("driver").alias("source"),
        F.lit("um").alias("market"),
        F.lit("DEPTHUSDT").alias("symbol"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("imported_at"),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as levels of order books by brand: even keys bid, odd ones ask from above all bids."""
    bid = F.col("p_partkey") % 2 == 0
    price = F.when(bid, F.col("p_retailprice")).otherwise(F.col("p_retailprice") + 10000)
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"), F.when(bid, "bid").otherwise("ask").alias("side"), price.alias("price"), F.col("p_size").cast("double").alias("qty"))


def books(spark: SparkSession, sf_dir: str, depth: int = 100) -> DataFrame:
    return market.books_from_levels(levels(spark, sf_dir).drop("p_partkey"), ["symbol"], depth)


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = latest(tape_raw(spark, sf_dir), ("market", "trade_id"))
    at = F.struct("event_time", "trade_id")
    out = df.groupBy("symbol").agg(
        F.max_by("price", at).alias("last_price"), F.min_by("price", at).alias("first_price"), F.sum(F.col("price") * F.col("qty")).alias("quote_volume"), F.max("price").alias("high_price"), F.min("price").alias("low_price")
    )
    return out.withColumn("price_change_percent", (F.col("last_price") - F.col("first_price")) / F.nullif("first_price", F.lit(0.0)) * 100).drop("first_price")


def premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticker's last price as mark price; its low and high make an index price, 0 for one symbol."""
    index = F.when(F.col("symbol") == "S3USDT", 0.0).otherwise((F.col("high_price") + F.col("low_price")) / 2)
    return tickers(spark, sf_dir).select("symbol", F.col("last_price").alias("mark_price"), index.alias("index_price"), (F.col("low_price") / 1e6).alias("last_funding_rate"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of files: the latest trades by market, symbol and day of week, as if each were one file."""
    df = latest(tape_raw(spark, sf_dir), ("market", "trade_id"))
    day = F.weekday("event_time").cast("int").alias("month")
    out = df.groupBy("market", "symbol", day).agg(F.count("*").alias("row_count"), F.min("event_time").alias("min_event_time"), F.max("event_time").alias("max_event_time"))
    return out.select(
        F.concat_ws("/", "market", "symbol", "month").alias("path"),
        *["market", "symbol", "month", "row_count", "min_event_time", "max_event_time"],
        (F.col("row_count") * 100).alias("file_size_bytes"),
        F.lit("trades").alias("dataset"),
        F.lit("driver").alias("source"),
        F.lit("trades").alias("profile"),
        F.lit(None).cast("string").alias("interval"),
        F.col("max_event_time").alias("created_at"),
    )


def day_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each day of orders; a few days have none."""
    day = F.to_date("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").groupBy(day.alias("min_event_time")).agg(F.count("*").alias("row_count")).withColumn("max_event_time", F.col("min_event_time"))


def account_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: c.cast("decimal(18,2)").cast("string")
    free = F.when(F.col("c_custkey") % 4 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal"))
    locked = F.when(F.col("c_custkey") % 4 == 0, F.lit(0)).otherwise(F.col("c_custkey") % 13)
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("asset"), cents(free).alias("free"), cents(locked).alias("locked"))


def account_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = lambda x: x.cast("decimal(18,2)").cast("string")
    amount = F.when(F.col("c_custkey") % 3 == 0, F.lit("0.000")).otherwise(text(F.col("c_acctbal")))
    return c.select(
        F.col("c_name").alias("symbol"), F.lit("BOTH").alias("positionSide"), amount.alias("positionAmt"), text(F.col("c_custkey")).alias("entryPrice"), text(F.col("c_custkey") + 1).alias("markPrice"), text(F.col("c_nationkey")).alias("unRealizedProfit"),
        F.lit("0").alias("liquidationPrice"), F.lit("5").alias("leverage"), F.lit("cross").alias("marginType"), F.lit("0").alias("isolatedMargin"), F.col("c_custkey").alias("updateTime"),
    )


def account_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = lambda x: x.cast("decimal(18,2)").cast("string")
    return o.select(
        F.lit("BTCUSDT").alias("symbol"), (F.col("o_orderkey") + 9007199254740993).alias("orderId"), F.concat(F.lit("c"), "o_orderkey").alias("clientOrderId"), F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.lit("BOTH").alias("positionSide"),
        F.lit("LIMIT").alias("type"), F.col("o_orderstatus").alias("status"), F.lit("GTC").alias("timeInForce"), text(F.col("o_totalprice")).alias("price"), F.lit("1").alias("origQty"), F.lit("0").alias("executedQty"), F.lit("0").alias("stopPrice"),
        F.lit(False).alias("reduceOnly"), F.lit(False).alias("closePosition"), F.col("o_custkey").alias("time"), F.col("o_custkey").alias("updateTime"),
    )


def account_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("BTCUSDT").alias("symbol"), F.upper("event_type").alias("incomeType"), F.round(F.col("value") * 100).cast("bigint").cast("string").alias("income"), F.lit("USDT").alias("asset"), F.lit("").alias("info"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), F.col("event_id").alias("tranId"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("user_id").cast("string")).alias("tradeId"),
    )


_TRADE = """SELECT event_id AS trade_id, value{plus} AS price, CAST(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS DOUBLE) AS qty,
 ts AS event_time, event_type IN ('error', 'purchase') AS is_buyer_maker, CASE WHEN user_id % 2 = 0 THEN 'spot' ELSE 'um' END AS market,
 'S' || CAST(user_id % 5 AS VARCHAR) || 'USDT' AS symbol, {at} AS imported_at FROM events{where}"""

SQL: dict[str, str] = {
    "tape_raw": _TRADE.format(plus="", at=1, where="") + " UNION ALL " + _TRADE.format(plus=" + 1", at=2, where=" WHERE event_id % 7 = 0"),
    "tape": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, trade_id ORDER BY imported_at DESC) AS rn FROM tape_raw) AS x WHERE rn = 1",
    "agg": "SELECT trade_id AS agg_trade_id, trade_id * 100 AS first_trade_id, trade_id * 100 + CAST(qty AS BIGINT) AS last_trade_id, CAST(qty AS BIGINT) + 1 AS span, price, qty, event_time, is_buyer_maker, market, symbol FROM tape",
    "metrics_raw": """SELECT o_orderdate AS event_time, o_totalprice AS sum_open_interest, o_totalprice * 2 AS sum_open_interest_value,
 CAST(o_custkey % 7 + 1 AS DOUBLE) AS count_toptrader_long_short_ratio, CAST(o_custkey % 5 + 1 AS DOUBLE) AS sum_toptrader_long_short_ratio,
 CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey % 3 AS DOUBLE) END AS count_long_short_ratio, CAST(o_custkey % 11 + 1 AS DOUBLE) AS sum_taker_long_short_vol_ratio,
 'metrics' AS dataset, 'driver' AS source, 'um' AS market, o_orderpriority AS symbol, o_orderkey AS imported_at FROM orders""",
    "metrics": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, event_time ORDER BY imported_at DESC) AS rn FROM metrics_raw) AS x WHERE rn = 1",
    "bookdepth_raw": """SELECT l_shipdate AS event_time, CASE WHEN l_linestatus = 'F' THEN -CAST(CAST(round(l_discount * 100) AS INTEGER) AS DOUBLE) ELSE CAST(CAST(round(l_discount * 100) AS INTEGER) AS DOUBLE) END AS percentage,
 l_quantity AS depth, l_extendedprice AS notional, 'bookdepth' AS dataset, 'driver' AS source, 'um' AS market, 'DEPTHUSDT' AS symbol, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem""",
    "bookdepth": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_time, percentage ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, notional DESC, depth DESC) AS rn FROM bookdepth_raw) AS x WHERE rn = 1",
    "tickers": """SELECT symbol, arg_max(price, o) AS last_price, (arg_max(price, o) - arg_min(price, o)) / nullif(arg_min(price, o), 0) * 100 AS price_change_percent, sum(price * qty) AS quote_volume,
 max(price) AS high_price, min(price) AS low_price FROM (SELECT *, row_number() OVER (ORDER BY event_time, trade_id) AS o FROM tape) AS x GROUP BY symbol""",
    "premium": "SELECT symbol, last_price AS mark_price, CASE WHEN symbol = 'S3USDT' THEN 0.0 ELSE (high_price + low_price) / 2 END AS index_price, low_price / 1e6 AS last_funding_rate FROM tickers",
    "manifest": """SELECT market || '/' || symbol || '/' || CAST(isodow(event_time) - 1 AS VARCHAR) AS path, market, symbol, CAST(isodow(event_time) - 1 AS INTEGER) AS month, count(*) AS row_count, min(event_time) AS min_event_time, max(event_time) AS max_event_time,
 count(*) * 100 AS file_size_bytes, 'trades' AS dataset, 'driver' AS source, 'trades' AS profile, CAST(NULL AS VARCHAR) AS interval_, max(event_time) AS created_at FROM tape GROUP BY market, symbol, isodow(event_time)""",
    "levels": """SELECT p_brand AS symbol, CASE WHEN p_partkey % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE p_retailprice + 10000 END AS price, CAST(p_size AS DOUBLE) AS qty FROM part""",
}


def candle_sql(seconds: int, interval: str) -> str:
    """Candles of the deduplicated tape."""
    bucket = f"time_bucket(to_seconds({seconds}), event_time)"
    return f"""SELECT {bucket} AS open_time, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close, sum(qty) AS volume,
 {bucket} + to_seconds({seconds}) - to_milliseconds(1) AS close_time, sum(price * qty) AS quote_asset_volume, count(*) AS trade_count,
 sum(CASE WHEN is_buyer_maker THEN 0 ELSE qty END) AS taker_buy_base_asset_volume, sum(CASE WHEN is_buyer_maker THEN 0 ELSE price * qty END) AS taker_buy_quote_asset_volume,
 'klines' AS dataset, 'driver' AS source, market, symbol, '{interval}' AS interval_
 FROM (SELECT *, row_number() OVER (ORDER BY event_time, trade_id) AS o FROM tape) AS x GROUP BY market, symbol, {bucket}"""


def bucket_sql(source: str, seconds: int, floor: float = 0) -> str:
    """Bucket aggregates of a deduplicated tape view, with the running delta."""
    key = "agg_trade_id" if source == "agg" else "trade_id"
    return f"""SELECT *, sum(taker_delta) OVER (PARTITION BY market, symbol ORDER BY bucket_start) AS cvd FROM (
 SELECT market, symbol, time_bucket(to_seconds({seconds}), event_time) AS bucket_start, count(*) AS trade_count, sum(qty) AS volume, sum(price * qty) AS quote_volume, sum(price * qty) / nullif(sum(qty), 0) AS vwap,
 sum(CASE WHEN is_buyer_maker THEN 0 ELSE qty END) AS taker_buy_volume, sum(CASE WHEN is_buyer_maker THEN qty ELSE 0 END) AS taker_sell_volume,
 sum(CASE WHEN is_buyer_maker THEN -qty ELSE qty END) / nullif(sum(qty), 0) AS taker_imbalance,
 count(*) FILTER (WHERE price * qty >= {floor}) AS large_trade_count, sum(price * qty) FILTER (WHERE price * qty >= {floor}) AS large_trade_notional,
 arg_min(price, o) AS open, arg_max(price, o) AS close, max(price) AS high, min(price) AS low, sum(CASE WHEN is_buyer_maker THEN -qty ELSE qty END) AS taker_delta
 FROM (SELECT *, row_number() OVER (ORDER BY event_time, {key}) AS o FROM {source}) AS x GROUP BY market, symbol, time_bucket(to_seconds({seconds}), event_time)) AS y"""


def level_sql(source: str, seconds: int) -> str:
    return f"""SELECT market, symbol, time_bucket(to_seconds({seconds}), event_time) AS bucket_start, price, sum(CASE WHEN is_buyer_maker THEN 0 ELSE qty END) AS taker_buy_volume,
 sum(CASE WHEN is_buyer_maker THEN qty ELSE 0 END) AS taker_sell_volume, sum(CASE WHEN is_buyer_maker THEN -qty ELSE qty END) AS delta, sum(qty) AS volume, count(*) AS trade_count,
 min(event_time) AS first_event_time, max(event_time) AS last_event_time FROM {source} GROUP BY market, symbol, time_bucket(to_seconds({seconds}), event_time), price"""


#: What each view is made of, so a query names only those it reads.
NEEDS = {"tape": ["tape_raw"], "agg": ["tape"], "metrics": ["metrics_raw"], "bookdepth": ["bookdepth_raw"], "tickers": ["tape"], "premium": ["tickers"], "manifest": ["tape"]}


def with_views(names: list[str], body: str, more: dict[str, str] | None = None, recursive: bool = False) -> str:
    """body after the views it needs and further ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in (more or {}).items()]
    return (f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) + "\n" if parts else "") + body
