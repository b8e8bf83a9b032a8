"""JSON answers of a market's public interface as typed tables: one text column `body` in, rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import finite

KLINE_FIELDS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_count")


def _doubles(row: Column, names: dict[str, str]) -> list[Column]:
    return [finite(row[k]).alias(v) for k, v in names.items()]


def klines(bodies: DataFrame) -> DataFrame:
    """Arrays of arrays with nine values or more, all of them finite numbers."""
    row = bodies.select(F.explode(F.from_json("body", "array<array<string>>")).alias("r"))
    row = row.where(F.when(F.size("r") >= len(KLINE_FIELDS), True).otherwise(F.raise_error(F.lit("a candle has too few values")).cast("boolean")))
    cells = [finite(F.get("r", F.lit(k))).alias(name) for k, name in enumerate(KLINE_FIELDS)]
    return row.select(*cells).withColumns({c: F.col(c).cast("long") for c in ("open_time", "close_time", "trade_count")})


def tickers(bodies: DataFrame) -> DataFrame:
    """One object or an array of them."""
    kind = "array<struct<symbol:string,lastPrice:string,priceChangePercent:string,quoteVolume:string,highPrice:string,lowPrice:string>>"
    text = F.when(F.ltrim("body").startswith("["), F.col("body")).otherwise(F.concat(F.lit("["), "body", F.lit("]")))
    row = bodies.select(F.explode(F.from_json(text, kind)).alias("r"))
    names = {"lastPrice": "last_price", "priceChangePercent": "price_change_percent", "quoteVolume": "quote_volume", "highPrice": "high_price", "lowPrice": "low_price"}
    return row.select(F.col("r.symbol").alias("symbol"), *_doubles(F.col("r"), names))


def order_books(bodies: DataFrame) -> DataFrame:
    row = bodies.select(F.from_json("body", "struct<symbol:string,lastUpdateId:bigint,bids:array<array<string>>,asks:array<array<string>>>").alias("r"))
    levels = lambda c: F.transform(c, lambda x: F.struct(finite(x[0]).alias("price"), finite(x[1]).alias("qty")))
    return row.select("r.symbol", F.col("r.lastUpdateId").alias("last_update_id"), levels(F.col("r.bids")).alias("bids"), levels(F.col("r.asks")).alias("asks"))


def exchange_info(bodies: DataFrame) -> DataFrame:
    """Exactly one symbol an answer; filters keep their scalar members as text."""
    kind = "struct<symbols:array<struct<symbol:string,status:string,baseAsset:string,quoteAsset:string,orderTypes:array<string>,filters:array<map<string,string>>>>>"
    row = bodies.select(F.from_json("body", kind)["symbols"].alias("s"))
    one = row.where(F.when(F.size("s") == 1, True).otherwise(F.raise_error(F.lit("not exactly one symbol")).cast("boolean"))).select(F.get("s", F.lit(0)).alias("s"))
    scalar = F.transform(F.col("s.filters"), lambda m: F.map_filter(m, lambda _, v: v.isNotNull() & ~v.startswith("{") & ~v.startswith("[")))
    return one.select("s.symbol", "s.status", F.col("s.baseAsset").alias("base_asset"), F.col("s.quoteAsset").alias("quote_asset"), F.col("s.orderTypes").alias("order_types"), scalar.alias("filters"))


def premium_index(bodies: DataFrame) -> DataFrame:
    names = {"markPrice": "mark_price", "indexPrice": "index_price", "estimatedSettlePrice": "estimated_settle_price", "lastFundingRate": "last_funding_rate"}
    row = bodies.select(F.from_json("body", "struct<symbol:string,markPrice:string,indexPrice:string,estimatedSettlePrice:string,lastFundingRate:string,nextFundingTime:bigint,time:bigint>").alias("r"))
    return row.select("r.symbol", *_doubles(F.col("r"), names), F.col("r.nextFundingTime").alias("next_funding_time"), "r.time")


def open_interest(bodies: DataFrame) -> DataFrame:
    row = bodies.select(F.from_json("body", "struct<symbol:string,openInterest:string,time:bigint>").alias("r"))
    return row.select("r.symbol", finite(F.col("r.openInterest")).alias("open_interest"), "r.time")


def funding_rates(bodies: DataFrame) -> DataFrame:
    """mark_price is null where the answer has none."""
    row = bodies.select(F.explode(F.from_json("body", "array<struct<symbol:string,fundingRate:string,fundingTime:bigint,markPrice:string>>")).alias("r"))
    mark = F.when(F.col("r.markPrice").isNotNull() & (F.col("r.markPrice") != ""), finite(F.col("r.markPrice")))
    return row.select("r.symbol", finite(F.col("r.fundingRate")).alias("funding_rate"), F.col("r.fundingTime").alias("funding_time"), mark.alias("mark_price"))
