"""Layouts of the files that ingest knows, and of the tables it makes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expressions import epoch_to_utc, text_to_bool, text_to_utc

# The columns of each file layout, in order, as "name type".
KLINE = "open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_asset_volume double, trade_count bigint, taker_buy_base_asset_volume double, taker_buy_quote_asset_volume double, ignore string"
TRADES_SPOT = "trade_id bigint, price double, qty double, quote_qty double, time bigint, is_buyer_maker string, is_best_match string"
TRADES_UM = "id bigint, price double, qty double, quote_qty double, time bigint, is_buyer_maker string"
AGG_SPOT = "agg_trade_id bigint, price double, qty double, first_trade_id bigint, last_trade_id bigint, time bigint, is_buyer_maker string, is_best_match string"
AGG_UM = "agg_trade_id bigint, price double, quantity double, first_trade_id bigint, last_trade_id bigint, transact_time bigint, is_buyer_maker string"
METRICS = "create_time string, symbol string, sum_open_interest double, sum_open_interest_value double, count_toptrader_long_short_ratio double, sum_toptrader_long_short_ratio double, count_long_short_ratio double, sum_taker_long_short_vol_ratio double"
BOOKDEPTH = "timestamp string, percentage double, depth double, notional double"


@dataclass(frozen=True)
class Layout:
    """One file layout: its columns and header, its time column, and what the table's columns are made of."""

    columns: str
    header: bool
    time: str
    made: tuple[Column | str, ...]


def _sides(best: bool) -> tuple[Column, Column]:
    return text_to_bool(F.col("is_buyer_maker")).alias("is_buyer_maker"), (text_to_bool(F.col("is_best_match")) if best else F.lit(None).cast("boolean")).alias("is_best_match")


def layouts() -> dict[tuple[str, str | None], Layout]:
    """By dataset and market; a market of None stands for any."""
    none = F.lit(None).cast("double").alias("quote_qty")
    event = lambda c: epoch_to_utc(F.col(c)).alias("event_time")
    at = lambda c: text_to_utc(F.col(c)).alias("event_time")
    ids = ("first_trade_id", "last_trade_id")
    kline = [c.split()[0] for c in KLINE.split(", ")]
    return {
        ("klines", None): Layout(KLINE, False, "open_time", tuple(epoch_to_utc(F.col(c)).alias(c) if c in ("open_time", "close_time") else c for c in kline if c != "ignore")),
        ("trades", "spot"): Layout(TRADES_SPOT, False, "event_time", ("trade_id", "price", "qty", "quote_qty", event("time"), *_sides(True))),
        ("trades", "um"): Layout(TRADES_UM, True, "event_time", (F.col("id").alias("trade_id"), "price", "qty", "quote_qty", event("time"), *_sides(False))),
        ("aggtrades", "spot"): Layout(AGG_SPOT, False, "event_time", ("agg_trade_id", "price", "qty", *ids, none, event("time"), *_sides(True))),
        ("aggtrades", "um"): Layout(AGG_UM, True, "event_time", ("agg_trade_id", "price", F.col("quantity").alias("qty"), *ids, none, event("transact_time"), *_sides(False))),
        ("metrics", "um"): Layout(METRICS, True, "event_time", (at("create_time"), *[c.split()[0] for c in METRICS.split(", ")[2:]])),
        ("bookdepth", "um"): Layout(BOOKDEPTH, True, "event_time", (at("timestamp"), "percentage", "depth", "notional")),
    }


#: Import profiles: the dataset that each makes, None where the caller names it.
PROFILES = {"kline": None, "trades": "trades", "aggtrades": "aggtrades", "metrics": "metrics", "bookdepth": "bookdepth", "generic-csv": None, "parquet": None}


def table_schema(spark: SparkSession, dataset: str, interval: str | None = None) -> StructType:
    """Columns of a dataset's tables, of any market; datasets that are not tapes or series hold candles."""
    own = [v for (name, _), v in layouts().items() if name == dataset] or [layouts()["klines", None]]
    # All markets' layouts make the same columns.
    made = spark.createDataFrame([], own[0].columns).select(*own[0].made)
    labels = ["dataset", "source", "market", "symbol"] + ["interval"] * (own[0].time == "open_time") + ["import_id"]
    more = {k: F.lit(None).cast("string") for k in labels} | {"imported_at": F.lit(None).cast("timestamp")}
    return made.withColumns(more).schema


FILES = "import_id string, path string, dataset string, source string, profile string, market string, symbol string, interval string, year int, month int, row_count bigint, file_size_bytes bigint, min_event_time timestamp_ntz, max_event_time timestamp_ntz, created_at timestamp"
JOBS = "import_id string, status string, dataset string, source string, profile string, market string, symbol string, interval string, checksum string, options string, message string, row_count bigint, created_at timestamp"
