"""Every registered query of the tape warehouse, with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import account, candles, catalog, flow, market, series, tape
from ..operators.core import capped, latest, newest, time_range
from ..sources.schemas import layouts
from ..sources.shared import shared_folder
from . import histories, imports  # noqa: F401  their queries are registered too
from . import views as V
from .registry import oracle_sql, queries, register  # noqa: F401

START, END = "2024-01-05T05:30:00+05:00", "2024-01-20T00:00:00Z"
START_SQL, END_SQL = "TIMESTAMP '2024-01-05 00:30:00'", "TIMESTAMP '2024-01-20 00:00:00'"
BY = ["market", "symbol"]


W = V.with_views
BUCKETS = "volume quote_volume vwap taker_buy_volume taker_sell_volume taker_imbalance large_trade_notional open close high low taker_delta cvd"
LEVELS = "price taker_buy_volume taker_sell_volume delta volume"
CANDLE = "open high low close volume quote_asset_volume taker_buy_base_asset_volume taker_buy_quote_asset_volume"
CANDLE_SQL = ", ".join(candles.COLUMNS).replace("interval", "interval_ AS interval")
TAPE_SQL = "trade_id, price, qty, price * qty AS quote_qty, event_time, is_buyer_maker, CAST(NULL AS BOOLEAN) AS is_best_match, 'trades' AS dataset, 'driver' AS source, market, symbol"


# -- scans and expressions -----------------------------------------------------------------------------------
@register("s3_parquet_union", "SELECT event_id AS id, ts AS at, value FROM events UNION ALL SELECT o_orderkey AS id, o_orderdate AS at, CAST(NULL AS DOUBLE) AS value FROM orders")
def _(spark, d):
    events = V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), "value")
    return events.unionByName(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")), allowMissingColumns=True)


@register("s1_csv_fixed", W(["tape_raw"], "SELECT trade_id, price, qty, price * qty AS quote_qty, event_time, is_buyer_maker, true AS is_best_match FROM tape_raw WHERE imported_at = 1"), "price quote_qty", 4)
def _(spark, d):
    """Trades written in the headerless seven-column layout and read again by it."""
    layout, path = layouts()["trades", "spot"], shared_folder(spark)
    df = V.tape_raw(spark, d).where("imported_at = 1")
    out = df.select("trade_id", "price", "qty", "quote_qty", F.unix_micros(F.col("event_time").cast("timestamp")), F.initcap(F.col("is_buyer_maker").cast("string")), F.lit("True"))
    out.write.csv(path)
    return spark.read.schema(layout.columns).option("mode", "FAILFAST").option("header", layout.header).csv(path).select(*layout.made)


@register("s2_csv_inferred", "SELECT CAST(event_id AS INTEGER) AS event_id, event_type, value FROM events")
def _(spark, d):
    path = shared_folder(spark)
    V.table(spark, d, "events").select("event_id", "event_type", "value").write.option("header", True).csv(path)
    return spark.read.option("header", True).option("inferSchema", True).option("mode", "FAILFAST").csv(path)


@register("e1_epoch_normalise", "SELECT event_id, ts AS event_time FROM events")
def _(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    # Even ids carry microseconds, odd ids milliseconds where nothing is lost by that.
    raw = F.when((F.col("event_id") % 2 == 0) | (micros % 1000 != 0), micros).otherwise(F.floor(micros / 1000))
    return V.table(spark, d, "events").select("event_id", E.epoch_to_utc(raw).alias("event_time"))


@register("e2_bool_text", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS flag FROM events")
def _(spark, d):
    text = F.element_at(F.array(*map(F.lit, ["True", "1", "FALSE", "0", "yes"])), (F.col("event_id") % 5 + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", E.text_to_bool(text).alias("flag"))


@register("e3_text_time", "SELECT o_orderkey, o_orderdate AS event_time FROM orders")
def _(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", E.text_to_utc(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("event_time"))


@register("e4_offset_bounds", W([], f"SELECT event_id, ts FROM events WHERE ts >= {START_SQL} AND ts <= {END_SQL}"))
def _(spark, d):
    t = F.col("ts")
    return V.table(spark, d, "events").where((t >= E.bound_to_utc(START)) & (t <= E.bound_to_utc(END))).select("event_id", "ts")


def _bucket_counts(seconds):
    def f(spark, d):
        return V.table(spark, d, "events").groupBy(E.bucket_start(F.col("ts"), seconds).alias("bucket_start")).agg(F.count("*").alias("n"))

    register(f"e6_bucket_{seconds}", f"SELECT time_bucket(to_seconds({seconds}), ts) AS bucket_start, count(*) AS n FROM events GROUP BY time_bucket(to_seconds({seconds}), ts)")(f)


for _s in (86400, 50000, 7):
    _bucket_counts(_s)


@register("e7_span", W(["agg"], "SELECT market, agg_trade_id, span FROM agg"))
def _(spark, d):
    df = latest(V.agg_raw(spark, d), tape.keys("aggtrades"))
    return df.select("market", "agg_trade_id", E.span(F.col("first_trade_id"), F.col("last_trade_id")).alias("span"))


@register("e8_notional_sides", W(["tape"], "SELECT market, trade_id, price * qty AS notional, CASE WHEN is_buyer_maker THEN 0 ELSE qty END AS buy, CASE WHEN is_buyer_maker THEN qty ELSE 0 END AS sell, CASE WHEN is_buyer_maker THEN -qty ELSE qty END AS signed FROM tape"), "notional")
def _(spark, d):
    maker, qty = F.col("is_buyer_maker"), F.col("qty")
    df = latest(V.tape_raw(spark, d), tape.keys("trades"))
    return df.select("market", "trade_id", (F.col("price") * qty).alias("notional"), E.taker_buy(maker, qty).alias("buy"), E.taker_sell(maker, qty).alias("sell"), E.signed(maker, qty).alias("signed"))


@register("f6_symbols", "SELECT c_custkey, CASE WHEN length(s) BETWEEN 5 AND 30 AND regexp_matches(s, '^[A-Z0-9]+$') THEN s END AS symbol FROM (SELECT c_custkey, upper(trim(' ' || c_mktsegment || ' ')) AS s FROM customer) AS x")
def _(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", E.normal_symbol(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("symbol"))


# -- latest revisions, order, limits -------------------------------------------------------------------------
@register("d1_dedup_tape", W(["tape"], "SELECT market, trade_id, price, qty, event_time, imported_at FROM tape"), "price")
def _(spark, d):
    return latest(V.tape_raw(spark, d), tape.keys("trades")).select("market", "trade_id", "price", "qty", "event_time", "imported_at")


@register("d1_dedup_candle", W(["tape"], "SELECT open_time, market, symbol, close FROM (SELECT *, row_number() OVER (PARTITION BY open_time ORDER BY market DESC, symbol DESC) AS rn FROM k) AS x WHERE rn = 1", {"k": V.candle_sql(3600, "1h")}), "close")
def _(spark, d):
    return latest(V.candles_raw(spark, d, 3600, "1h"), ["open_time"], ["market", "symbol"]).select("open_time", "market", "symbol", "close")


@register("d1_dedup_series", W(["metrics"], "SELECT symbol, event_time, sum_open_interest, imported_at FROM metrics"), "sum_open_interest")
def _(spark, d):
    return latest(V.metrics_raw(spark, d), series.METRICS.all_keys).select("symbol", "event_time", "sum_open_interest", "imported_at")


@register("d2_newest_n", W(["tape"], "SELECT market, trade_id, event_time, price FROM tape ORDER BY event_time DESC, trade_id DESC LIMIT 500"), "price")
def _(spark, d):
    df = latest(V.tape_raw(spark, d), tape.keys("trades"))
    return newest(df.select("market", "trade_id", "event_time", "price"), "event_time", 500, ["trade_id"])


@register("d5_capped", "SELECT time_bucket(to_seconds(3600), ts) AS bucket_start, count(*) AS n FROM events GROUP BY time_bucket(to_seconds(3600), ts)")
def _(spark, d):
    df = V.table(spark, d, "events").groupBy(E.bucket_start(F.col("ts"), 3600).alias("bucket_start")).agg(F.count("*").alias("n"))
    return capped(df, 5000, [F.asc("bucket_start")], "buckets")


TICKER = "last_price price_change_percent quote_volume high_price low_price"


@register("d6_top30", W(["tickers"], "SELECT * FROM tickers WHERE symbol LIKE '%USDT' ORDER BY quote_volume DESC, symbol LIMIT 30"), TICKER)
def _(spark, d):
    return market.overview(V.tickers(spark, d))


@register("d7_compare", W(["tickers"], "SELECT * FROM tickers WHERE symbol IN ('S1USDT', 'S4USDT', 'NOUSDT')"), TICKER)
def _(spark, d):
    return market.compare(V.tickers(spark, d), ["S1USDT", "S4USDT", "NOUSDT"])


# -- tape ----------------------------------------------------------------------------------------------------
@register(
    "p2_price_band_before_dedup",
    W(["tape_raw"], "SELECT market, symbol, count(*) AS row_count, sum(price) AS price_sum FROM (SELECT *, row_number() OVER (PARTITION BY market, trade_id ORDER BY imported_at DESC) AS rn FROM tape_raw WHERE price >= 20 AND price <= 60) AS x WHERE rn = 1 GROUP BY market, symbol"),
    "price_sum",
    4,
)
def _(spark, d):
    return tape.scoped(V.tape_raw(spark, d), "trades", min_price=20, max_price=60).groupBy(*BY).agg(F.count("*").alias("row_count"), F.sum("price").alias("price_sum"))


@register("p3_large_rows", W(["tape_raw"], "SELECT market, trade_id, price, qty FROM (SELECT *, row_number() OVER (PARTITION BY market, trade_id ORDER BY imported_at DESC) AS rn FROM tape_raw WHERE price * qty >= 5000) AS x WHERE rn = 1"), "price")
def _(spark, d):
    return tape.scoped(V.tape_raw(spark, d), "trades", min_notional=5000).select("market", "trade_id", "price", "qty")


@register("p4_min_span", W(["agg"], "SELECT market, agg_trade_id, span FROM agg WHERE span >= 50"))
def _(spark, d):
    return tape.scoped(V.agg_raw(spark, d), "aggtrades", min_span=50).select("market", "agg_trade_id", E.span(F.col("first_trade_id"), F.col("last_trade_id")).alias("span"))


@register("q1_candles", W(["tape"], f"SELECT {CANDLE_SQL} FROM k ORDER BY open_time DESC, market DESC, symbol DESC LIMIT 5000", {"k": V.candle_sql(3600, "1h")}), CANDLE)
def _(spark, d):
    return candles.candles(V.candles_raw(spark, d, 3600, "1h"), limit=5000, keys=["open_time", "market", "symbol"])


@register("q2_candle_range", W(["tape"], "SELECT count(DISTINCT open_time) AS row_count, min(open_time) AS min_time, max(open_time) AS max_time FROM k", {"k": V.candle_sql(3600, "1h")}))
def _(spark, d):
    return candles.candle_range(V.candles_raw(spark, d, 3600, "1h"))


@register("q3_tape_rows_trades", W(["tape_raw"], f"SELECT {TAPE_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY market, trade_id ORDER BY imported_at DESC) AS rn FROM tape_raw WHERE event_time >= {START_SQL} AND event_time <= {END_SQL}) AS x WHERE rn = 1 ORDER BY event_time DESC, trade_id DESC LIMIT 500").replace("price * qty AS quote_qty", "(price - CASE WHEN imported_at = 2 THEN 1 ELSE 0 END) * qty AS quote_qty"), "price qty quote_qty", 4)
def _(spark, d):
    return tape.tape_rows(V.tape_raw(spark, d), "trades", 500, start=START, end=END)


@register("q3_tape_rows_agg", W(["agg"], "SELECT agg_trade_id, first_trade_id, last_trade_id, span, price, qty, CAST(NULL AS DOUBLE) AS quote_qty, event_time, is_buyer_maker, CAST(NULL AS BOOLEAN) AS is_best_match, 'aggtrades' AS dataset, 'driver' AS source, market, symbol FROM agg ORDER BY event_time DESC, agg_trade_id DESC LIMIT 500"), "price qty")
def _(spark, d):
    return tape.tape_rows(V.agg_raw(spark, d), "aggtrades", 500)


def tape_buckets(spark, d):
    return tape.tape_buckets(V.tape_raw(spark, d), "trades", 3600)


register("q4_tape_buckets", W(["tape"], V.bucket_sql("tape", 3600)), BUCKETS)(tape_buckets)


@register("q4_tape_buckets_floor", W(["agg"], V.bucket_sql("agg", 50000, 3000)), BUCKETS)
def _(spark, d):
    return tape.tape_buckets(V.agg_raw(spark, d), "aggtrades", 50000, min_notional=3000)


@register("q5_footprint", W(["tape"], V.level_sql("tape", 86400) + "", {}), LEVELS)
def _(spark, d):
    return tape.footprint(V.tape_raw(spark, d), "trades", 86400, "1900-01-01T00:00:00Z", "2200-01-01T00:00:00Z")


@register("q6_tape_range", W(["tape"], "SELECT market, symbol, count(*) AS row_count, min(event_time) AS min_time, max(event_time) AS max_time FROM tape GROUP BY market, symbol"))
def _(spark, d):
    return tape.tape_range(V.tape_raw(spark, d), "trades", BY)


@register("w2_cvd", W(["tape"], f"SELECT market, symbol, bucket_start, taker_delta, cvd FROM ({V.bucket_sql('tape', 900)}) AS b"), "taker_delta cvd")
def _(spark, d):
    return tape.tape_buckets(V.tape_raw(spark, d), "trades", 900).select(*BY, "bucket_start", "taker_delta", "cvd")


# -- series --------------------------------------------------------------------------------------------------
VALUES = " ".join(series.METRICS.values)


@register("q7_series_metrics", W(["metrics"], f"SELECT event_time, {', '.join(series.METRICS.values)}, dataset, source, market, symbol FROM metrics ORDER BY event_time DESC, symbol DESC LIMIT 500"), VALUES)
def _(spark, d):
    return series.series_rows(V.metrics_raw(spark, d), series.METRICS, 500)


@register("q7_series_band", W(["bookdepth"], "SELECT event_time, percentage, depth, notional, dataset, source, market, symbol FROM bookdepth WHERE percentage = -5 ORDER BY event_time DESC LIMIT 500"), "depth notional")
def _(spark, d):
    return series.series_rows(V.bookdepth_raw(spark, d), series.BOOKDEPTH, 500, percentage=-5.0)


def _series_sql(view: str, spec: series.SeriesSpec, seconds: int) -> str:
    made = ", ".join(f"avg({v}) AS {v}_avg, min({v}) AS {v}_min, max({v}) AS {v}_max, arg_max({v}, event_time) FILTER (WHERE {v} IS NOT NULL) AS {v}_last" for v in spec.values)
    keys = "".join(f", {k}" for k in spec.keys)
    bucket = f"time_bucket(to_seconds({seconds}), event_time)"
    return W([view], f"SELECT market, symbol, {bucket} AS bucket_start{keys}, {made} FROM {view} GROUP BY market, symbol, {bucket}{keys}")


def _stat_names(spec: series.SeriesSpec) -> str:
    return " ".join(f"{v}_{s}" for v in spec.values for s in ("avg", "min", "max", "last"))


@register("q8_metrics_buckets", _series_sql("metrics", series.METRICS, 604800), _stat_names(series.METRICS), 4)
def _(spark, d):
    return series.series_buckets(V.metrics_raw(spark, d), series.METRICS, 604800)


@register("q8_bookdepth_buckets", _series_sql("bookdepth", series.BOOKDEPTH, 86400), _stat_names(series.BOOKDEPTH), 4)
def _(spark, d):
    return series.series_buckets(V.bookdepth_raw(spark, d), series.BOOKDEPTH, 86400)


@register("q9_series_range", W(["metrics"], "SELECT symbol, count(*) AS row_count, min(event_time) AS min_time, max(event_time) AS max_time FROM metrics GROUP BY symbol"))
def _(spark, d):
    return series.series_range(V.metrics_raw(spark, d), series.METRICS, ["symbol"])


# -- catalog -------------------------------------------------------------------------------------------------
DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders"


@register("q10_coverage_summary", f"SELECT count(*) AS covered_day_count, min(day) AS first_day, max(day) AS last_day, date_diff('day', min(day), max(day)) + 1 AS expected_day_count, date_diff('day', min(day), max(day)) + 1 - count(*) AS missing_day_count, date_diff('day', min(day), max(day)) + 1 - count(*) > 800 AS truncated, count(*) > 800 AS covered_days_truncated FROM ({DAYS}) AS x")
def _(spark, d):
    return catalog.coverage(V.day_files(spark, d)).drop("missing_days", "covered_days")


@register("q10_missing_days", f"SELECT CAST(day AS DATE) AS day FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL '1 day')) AS day FROM ({DAYS}) AS x) AS y WHERE CAST(day AS DATE) NOT IN ({DAYS})")
def _(spark, d):
    return catalog.missing_days(V.day_files(spark, d))


@register("q11_datasets", W(["manifest"], "SELECT dataset, source, profile, market, symbol, interval_ AS interval, count(*) AS file_count, CAST(sum(row_count) AS BIGINT) AS row_count, min(min_event_time) AS min_event_time, max(max_event_time) AS max_event_time FROM manifest GROUP BY dataset, source, profile, market, symbol, interval_"))
def _(spark, d):
    return catalog.list_datasets(V.manifest(spark, d))


@register("q12_files", W(["manifest"], "SELECT path, market, symbol, month, row_count, min_event_time, max_event_time, file_size_bytes, dataset, source, profile, interval_ AS interval, created_at FROM manifest WHERE market = 'um' ORDER BY created_at DESC, path LIMIT 100"))
def _(spark, d):
    return catalog.list_files(V.manifest(spark, d), 100, market="um")


@register("q13_status", W(["manifest"], "SELECT count(*) AS file_count, CAST(sum(row_count) AS BIGINT) AS row_count, CAST(sum(file_size_bytes) AS BIGINT) AS byte_count FROM manifest"))
def _(spark, d):
    return catalog.totals(V.manifest(spark, d))


@register("p8_file_overlap", W(["manifest"], f"SELECT path FROM manifest WHERE date_trunc('second', max_event_time) >= {START_SQL} AND date_trunc('second', min_event_time) <= TIMESTAMP '2024-01-06 00:00:00'"))
def _(spark, d):
    return catalog.overlapping(V.manifest(spark, d), START, "2024-01-06T00:00:00Z").select("path")


# -- indicators ----------------------------------------------------------------------------------------------
RECENT = "SELECT *, row_number() OVER (PARTITION BY market, symbol ORDER BY open_time) AS i FROM (SELECT *, row_number() OVER (PARTITION BY market, symbol ORDER BY open_time DESC) AS back FROM k) AS x WHERE back <= 560"


def _indicator_sql(body: str, more: dict[str, str] | None = None) -> str:
    return W(["tape"], body, {"k": V.candle_sql(3600, "1h"), "c": RECENT, **(more or {})}, recursive=True)


def _ema_cte(name: str, n: int, source: str = "c", value: str = "close") -> str:
    k = f"(2.0 / {n + 1})"
    return f"""SELECT market, symbol, {n} AS i, avg({value}) AS v FROM {source} WHERE i <= {n} GROUP BY market, symbol HAVING count(*) = {n}
 UNION ALL SELECT s.market, s.symbol, s.i, s.{value} * {k} + e.v * (1 - {k}) FROM {name} AS e JOIN {source} AS s ON s.market = e.market AND s.symbol = e.symbol AND s.i = e.i + 1"""


def _indicators(spark, d):
    return candles.indicator_frame(V.candles_raw(spark, d, 3600, "1h"))


@register("i1_sma20", _indicator_sql("SELECT market, symbol, CASE WHEN max(i) >= 20 THEN avg(close) FILTER (WHERE back <= 20) END AS sma20 FROM c GROUP BY market, symbol"), "sma20")
def _(spark, d):
    return _indicators(spark, d).select(*BY, "sma20")


@register("i2_ema20", _indicator_sql("SELECT market, symbol, arg_max(v, i) AS ema20 FROM e20 GROUP BY market, symbol", {"e20": _ema_cte("e20", 20)}), "ema20")
def _(spark, d):
    return _indicators(spark, d).where("ema20 is not null").select(*BY, "ema20")


STEPS = "SELECT market, symbol, i, greatest(close - before, 0) AS gain, greatest(before - close, 0) AS loss, greatest(high - low, abs(high - before), abs(low - before)) AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY market, symbol ORDER BY i) AS before FROM c) AS x WHERE i > 1"
RSI = """SELECT market, symbol, 15 AS i, avg(gain) AS g, avg(loss) AS l FROM steps WHERE i <= 15 GROUP BY market, symbol HAVING count(*) = 14
 UNION ALL SELECT s.market, s.symbol, s.i, (r.g * 13 + s.gain) / 14, (r.l * 13 + s.loss) / 14 FROM r JOIN steps AS s ON s.market = r.market AND s.symbol = r.symbol AND s.i = r.i + 1"""
ATR = """SELECT market, symbol, 15 AS i, avg(tr) AS v FROM steps WHERE i <= 15 GROUP BY market, symbol HAVING count(*) = 14
 UNION ALL SELECT s.market, s.symbol, s.i, (a.v * 13 + s.tr) / 14 FROM a JOIN steps AS s ON s.market = a.market AND s.symbol = a.symbol AND s.i = a.i + 1"""
RSI_VALUE = "SELECT market, symbol, CASE WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi14 FROM (SELECT market, symbol, arg_max(g, i) AS g, arg_max(l, i) AS l FROM r GROUP BY market, symbol) AS x"


@register("i3_rsi14", _indicator_sql(RSI_VALUE, {"steps": STEPS, "r": RSI}), "rsi14", 8)
def _(spark, d):
    return _indicators(spark, d).where("rsi14 is not null").select(*BY, "rsi14")


@register(
    "i4_macd",
    _indicator_sql(
        "SELECT l.market, l.symbol, l.line AS macd_line, s.v AS macd_signal, l.line - s.v AS macd_histogram FROM (SELECT market, symbol, arg_max(line, i) AS line FROM lines GROUP BY market, symbol) AS l JOIN (SELECT market, symbol, arg_max(v, i) AS v FROM sig GROUP BY market, symbol) AS s ON l.market = s.market AND l.symbol = s.symbol",
        {"e12": _ema_cte("e12", 12), "e26": _ema_cte("e26", 26), "lines": "SELECT a.market, a.symbol, a.i - 25 AS i, a.v - b.v AS line FROM e12 AS a JOIN e26 AS b ON a.market = b.market AND a.symbol = b.symbol AND a.i = b.i", "sig": _ema_cte("sig", 9, "lines", "line")},
    ),
    "macd_line macd_signal macd_histogram",
    8,
)
def _(spark, d):
    m = F.col("macd")
    return _indicators(spark, d).where("macd is not null").select(*BY, m["line"].alias("macd_line"), m["signal"].alias("macd_signal"), m["histogram"].alias("macd_histogram"))


@register("i5_bollinger", _indicator_sql("SELECT market, symbol, avg(close) + 2 * stddev_pop(close) AS upper_band, avg(close) AS middle_band, avg(close) - 2 * stddev_pop(close) AS lower_band FROM c WHERE back <= 20 GROUP BY market, symbol HAVING count(*) = 20"), "upper_band middle_band lower_band", 8)
def _(spark, d):
    b = F.col("bollinger20")
    return _indicators(spark, d).where("bollinger20 is not null").select(*BY, b["upper"].alias("upper_band"), b["middle"].alias("middle_band"), b["lower"].alias("lower_band"))


@register("i6_atr14", _indicator_sql("SELECT market, symbol, arg_max(v, i) AS atr14 FROM a GROUP BY market, symbol", {"steps": STEPS, "a": ATR}), "atr14", 8)
def _(spark, d):
    return _indicators(spark, d).where("atr14 is not null").select(*BY, "atr14")


def _status_sql(name: str, n: int) -> str:
    return f"CASE WHEN max(i) < {n} THEN 'insufficient_data'" + (f" WHEN max(i) = {n} THEN 'degraded'" if name == "ema20" else "") + f" ELSE 'ok' END AS {name}_status"


@register("i7_status", _indicator_sql(f"SELECT market, symbol, max(i) AS candle_count, greatest(max(i) - 500, 0) AS warmup_candles, {', '.join(_status_sql(k, v) for k, v in candles.I.NEEDS.items())} FROM c GROUP BY market, symbol"))
def _(spark, d):
    out = _indicators(spark, d)
    return out.select(*BY, F.col("candle_count").cast("long").alias("candle_count"), F.col("warmup_candles").cast("long").alias("warmup_candles"), *[F.col(f"status.{k}").alias(f"{k}_status") for k in candles.I.NEEDS])


LATEST = "SELECT market, symbol, arg_max(close, i) AS close, max(close_time) AS close_time FROM c GROUP BY market, symbol"
TREND_SQL = "CASE WHEN e.v IS NULL THEN 'insufficient_data' WHEN l.close > e.v THEN 'uptrend' ELSE 'downtrend' END"
EMA_LAST = "SELECT market, symbol, arg_max(v, i) AS v FROM e20 GROUP BY market, symbol"


@register(
    "c2_trend",
    _indicator_sql(
        f"SELECT l.market, l.symbol, l.close AS latest_close, {TREND_SQL} AS trend, CASE WHEN r.rsi14 IS NULL THEN 'unknown' WHEN r.rsi14 >= 70 THEN 'overbought' WHEN r.rsi14 <= 30 THEN 'oversold' ELSE 'neutral' END AS momentum FROM ({LATEST}) AS l LEFT JOIN ({EMA_LAST}) AS e ON l.market = e.market AND l.symbol = e.symbol LEFT JOIN ({RSI_VALUE}) AS r ON l.market = r.market AND l.symbol = r.symbol",
        {"e20": _ema_cte("e20", 20), "steps": STEPS, "r": RSI},
    ),
    "latest_close",
)
def _(spark, d):
    return candles.trends(V.candles_raw(spark, d, 3600, "1h")).select(*BY, "latest_close", "trend", "momentum")


def _frames(spark, d):
    """Candles of three widths from one pass over the tape: the longer are made of the hourly ones."""
    hours = tape.to_candles(V.tape_raw(spark, d), "trades", 3600, "1h")
    return tape.widened(hours, {"1h": 3600, "4h": 14400, "1d": 86400}).withColumn("imported_at", F.lit(1))


def _frame_sql() -> str:
    more: dict[str, str] = {}
    picks = []
    for name, seconds in (("1h", 3600), ("4h", 14400), ("1d", 86400)):
        k = f"f{name[0]}"
        k = {"1h": "fa", "4h": "fb", "1d": "fc"}[name]
        more[f"k{k}"] = V.candle_sql(seconds, name)
        more[f"c{k}"] = RECENT.replace("FROM k)", f"FROM k{k})")
        more[f"e{k}"] = _ema_cte(f"e{k}", 20, f"c{k}")
        picks.append(f"SELECT l.market, l.symbol, {TREND_SQL} AS trend, l.close_time FROM ({LATEST.replace('FROM c ', f'FROM c{k} ')}) AS l LEFT JOIN ({EMA_LAST.replace('FROM e20', f'FROM e{k}')}) AS e ON l.market = e.market AND l.symbol = e.symbol")
    body = f"""SELECT market, symbol, CASE WHEN known = 0 THEN 'insufficient_data' WHEN up = known THEN 'bullish_aligned' WHEN up = 0 THEN 'bearish_aligned' ELSE 'mixed' END AS alignment, data_time
 FROM (SELECT market, symbol, count(*) FILTER (WHERE trend = 'uptrend') AS up, count(*) FILTER (WHERE trend <> 'insufficient_data') AS known, max(close_time) AS data_time FROM ({' UNION ALL '.join(picks)}) AS t GROUP BY market, symbol) AS v"""
    return W(["tape"], body, more, recursive=True)


@register("c3_multi_timeframe", _frame_sql())
def _(spark, d):
    return candles.multi_timeframe(_frames(spark, d)).drop("trends")


# -- snapshots -----------------------------------------------------------------------------------------------
BOOK_SQL = """SELECT symbol, max(price) FILTER (WHERE side = 'bid') AS best_bid, min(price) FILTER (WHERE side = 'ask') AS best_ask, min(price) FILTER (WHERE side = 'ask') - max(price) FILTER (WHERE side = 'bid') AS spread,
 (min(price) FILTER (WHERE side = 'ask') - max(price) FILTER (WHERE side = 'bid')) / nullif(min(price) FILTER (WHERE side = 'ask'), 0) * 100 AS spread_percent, sum(price * qty) FILTER (WHERE side = 'bid') AS bid_notional, sum(price * qty) FILTER (WHERE side = 'ask') AS ask_notional,
 sum(price * qty) FILTER (WHERE side = 'bid') / nullif(sum(price * qty), 0) AS bid_ask_imbalance FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END, qty DESC) AS k FROM levels) AS x WHERE k <= 100 GROUP BY symbol"""


@register("c4_order_book", W(["levels"], BOOK_SQL), "best_bid best_ask spread spread_percent bid_notional ask_notional bid_ask_imbalance", 4)
def _(spark, d):
    return market.order_book_summary(V.books(spark, d))


MARK = "mark_price index_price last_funding_rate basis_percent funding_rate_percent"
MARK_SQL = "SELECT symbol, mark_price, index_price, last_funding_rate, (mark_price - index_price) / nullif(index_price, 0) * 100 AS basis_percent, last_funding_rate * 100 AS funding_rate_percent FROM premium"


@register("c5_mark_price", W(["premium"], MARK_SQL), MARK, 8)
def _(spark, d):
    return market.mark_price(V.premium(spark, d))


@register("c6_funding", "SELECT event_id, value / 1e6 AS funding_rate, value / 1e6 * 100 AS funding_rate_percent FROM events", "funding_rate funding_rate_percent", 8)
def _(spark, d):
    return market.funding_history(V.table(spark, d, "events").select("event_id", (F.col("value") / 1e6).alias("funding_rate")))


@register(
    "c7_futures_analyze",
    W(["premium"], f"SELECT l.symbol, l.close AS latest_close, e.v AS ema20, {TREND_SQL} AS trend, t.last_price, t.price_change_percent, t.quote_volume, t.high_price, t.low_price, m.mark_price, m.index_price, m.last_funding_rate, m.basis_percent, m.funding_rate_percent, CAST(t.quote_volume / 10 AS DOUBLE) AS open_interest FROM ({LATEST}) AS l LEFT JOIN ({EMA_LAST}) AS e ON l.market = e.market AND l.symbol = e.symbol JOIN tickers AS t ON t.symbol = l.symbol JOIN ({MARK_SQL}) AS m ON m.symbol = l.symbol WHERE l.market = 'um'", {"k": V.candle_sql(3600, "1h"), "c": RECENT, "e20": _ema_cte("e20", 20)}, recursive=True),
    f"latest_close ema20 {TICKER} {MARK} open_interest",
    4,
)
def _(spark, d):
    trend = candles.trends(V.candles_raw(spark, d, 3600, "1h").where("market = 'um'"))
    interest = V.tickers(spark, d).select("symbol", (F.col("quote_volume") / 10).alias("open_interest"))
    return market.futures_report(trend, V.tickers(spark, d), V.premium(spark, d), interest)


# -- account -------------------------------------------------------------------------------------------------
_CENTS = "CAST(CAST({} AS DECIMAL(18, 2)) AS VARCHAR)"


@register("ac1_balances", f"SELECT c_name AS asset, {_CENTS.format('c_acctbal')} AS free, {_CENTS.format('c_custkey % 13')} AS locked, CAST(CAST(c_acctbal AS DECIMAL(18, 2)) + CAST(c_custkey % 13 AS DECIMAL(18, 2)) AS VARCHAR) AS total FROM customer WHERE c_custkey % 4 <> 0 AND CAST(c_acctbal AS DECIMAL(18, 2)) + CAST(c_custkey % 13 AS DECIMAL(18, 2)) <> 0")
def _(spark, d):
    return account.balances(V.account_balances(spark, d))


@register(
    "ac2_positions",
    f"""SELECT c_name AS symbol, 'BOTH' AS "positionSide", {_CENTS.format('c_acctbal')} AS "positionAmount", {_CENTS.format('c_custkey')} AS "entryPrice", CAST(NULL AS VARCHAR) AS "breakEvenPrice", {_CENTS.format('c_custkey + 1')} AS "markPrice", {_CENTS.format('c_nationkey')} AS "unrealizedProfit",
 '0' AS "liquidationPrice", '5' AS leverage, 'cross' AS "marginType", '0' AS "isolatedMargin", CAST(NULL AS VARCHAR) AS notional, c_custkey AS "updateTime" FROM customer WHERE c_custkey % 3 <> 0 AND CAST(c_acctbal AS DECIMAL(18, 2)) <> 0""",
)
def _(spark, d):
    return account.positions(V.account_positions(spark, d))


@register(
    "ac3_open_orders",
    f"""SELECT 'BTCUSDT' AS symbol, CAST(o_orderkey + 9007199254740993 AS VARCHAR) AS "orderId", 'c' || CAST(o_orderkey AS VARCHAR) AS "clientOrderId", CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 'BOTH' AS "positionSide", 'LIMIT' AS type, o_orderstatus AS status, 'GTC' AS "timeInForce", {_CENTS.format('o_totalprice')} AS price,
 '1' AS "originalQuantity", '0' AS "executedQuantity", '0' AS "stopPrice", false AS "reduceOnly", false AS "closePosition", o_custkey AS time, o_custkey AS "updateTime" FROM orders""",
)
def _(spark, d):
    return account.open_orders(V.account_orders(spark, d))


@register(
    "ac4_income",
    """SELECT 'BTCUSDT' AS symbol, upper(event_type) AS "incomeType", CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS income, 'USDT' AS asset, '' AS info, epoch_us(ts) // 1000 AS time, CAST(event_id AS VARCHAR) AS "transactionId", CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS "tradeId" FROM events""",
)
def _(spark, d):
    return account.income(V.account_income(spark, d))


# -- order flow ----------------------------------------------------------------------------------------------
HOURLY = {"b": V.bucket_sql("tape", 3600)}


@register("t1_ratio_rescale", W(["metrics"], "SELECT symbol, event_time, (sum_taker_long_short_vol_ratio - 1) / nullif(sum_taker_long_short_vol_ratio + 1, 0) AS signed_share FROM metrics"), "signed_share")
def _(spark, d):
    df = latest(V.metrics_raw(spark, d), series.METRICS.all_keys)
    return flow.rescaled(df, "sum_taker_long_short_vol_ratio").select("symbol", "event_time", "signed_share")


@register("t2_weighted_unweighted", W(["tape"], "SELECT market, symbol, sum(taker_delta) / nullif(sum(taker_buy_volume + taker_sell_volume), 0) AS weighted_imbalance, avg(taker_imbalance) AS unweighted_imbalance, count(*) AS bucket_count FROM b GROUP BY market, symbol", HOURLY), "weighted_imbalance unweighted_imbalance")
def _(spark, d):
    return flow.period_imbalance(tape_buckets(spark, d), BY)


@register("t3_divergence", W(["tape"], "SELECT market, symbol, bucket_start, close - pc AS price_change, cvd - pv AS cvd_change, coalesce(sign(close - pc) * sign(cvd - pv) < 0, false) AS diverging FROM (SELECT *, lag(close) OVER (PARTITION BY market, symbol ORDER BY bucket_start) AS pc, lag(cvd) OVER (PARTITION BY market, symbol ORDER BY bucket_start) AS pv FROM b) AS x", HOURLY), "price_change cvd_change")
def _(spark, d):
    return flow.divergence(tape_buckets(spark, d), BY)


@register("t4_block_ratio", W(["tape"], "SELECT market, symbol, bucket_start, coalesce(large_trade_notional, 0) / nullif(quote_volume, 0) AS block_ratio FROM b", {"b": V.bucket_sql("tape", 3600, 3000)}), "block_ratio")
def _(spark, d):
    return flow.block_ratio(tape.tape_buckets(V.tape_raw(spark, d), "trades", 3600, min_notional=3000), BY)


@register("t5_sweeps", W(["tape_raw"], "SELECT market, symbol, trade_id AS agg_trade_id, event_time, price * qty AS notional, CAST(qty AS BIGINT) + 1 AS span, CASE WHEN CAST(qty AS BIGINT) + 1 > 50 THEN 'sweep' ELSE 'heavy_fill' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY market, trade_id ORDER BY imported_at DESC) AS rn FROM tape_raw WHERE price * qty >= 3000) AS x WHERE rn = 1"), "notional")
def _(spark, d):
    return flow.sweeps(V.agg_raw(spark, d), 3000, 50)


WEEKLY = {"p": V.level_sql("u", 86400)}
UNIT = "SELECT market, symbol, trade_id, floor(price / 10) * 10 AS price, qty, event_time, is_buyer_maker FROM tape"


def _levels(spark, d, seconds=86400):
    """Levels ten units wide, so that each is hit more than once."""
    df = latest(V.tape_raw(spark, d), tape.keys("trades")).withColumn("price", F.floor(F.col("price") / 10).cast("double") * 10)
    return tape.footprint(df, "trades", seconds, "1900-01-01T00:00:00Z", "2200-01-01T00:00:00Z")


@register(
    "t6_absorption",
    W(["tape"], """SELECT market, symbol, bucket_start, price, delta, volume, trade_count, cover, one_sided, progress FROM (SELECT *, (epoch_us(last_event_time) - epoch_us(first_event_time)) / (1e6 * 86400) AS cover, abs(delta) / nullif(volume, 0) AS one_sided,
 last_value(price) OVER (PARTITION BY market, symbol, bucket_start ORDER BY last_event_time, price ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - first_value(price) OVER (PARTITION BY market, symbol, bucket_start ORDER BY first_event_time, price ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS progress FROM p) AS x
 WHERE trade_count >= 2 AND one_sided >= 0.2 AND cover >= 0.5 AND CASE WHEN delta > 0 THEN progress <= 0 ELSE progress >= 0 END""", {"u": UNIT, **WEEKLY}),
    "delta volume cover one_sided progress",
)
def _(spark, d):
    return flow.absorption(_levels(spark, d), 86400, min_one_sided=0.2)


@register(
    "t7_exhaustion",
    W(["tape"], """SELECT market, symbol, bucket_start, CASE WHEN high > top THEN 'high' ELSE 'low' END AS extreme, high, low, volume, taker_delta FROM (SELECT *, lag(volume) OVER w AS v1, lag(volume, 2) OVER w AS v2, lag(abs(taker_delta)) OVER w AS d1, lag(abs(taker_delta), 2) OVER w AS d2,
 max(high) OVER (PARTITION BY market, symbol ORDER BY bucket_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, min(low) OVER (PARTITION BY market, symbol ORDER BY bucket_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bottom FROM b WINDOW w AS (PARTITION BY market, symbol ORDER BY bucket_start)) AS x
 WHERE volume < v1 AND v1 < v2 AND abs(taker_delta) < d1 AND d1 < d2 AND (high > top OR low < bottom)""", HOURLY),
    "high low volume taker_delta",
)
def _(spark, d):
    return flow.exhaustion(tape_buckets(spark, d), BY)


INTEREST = "SELECT time_bucket(to_seconds(86400), event_time) AS bucket_start, 'S' || CAST(trade_id % 5 AS VARCHAR) || 'USDT' AS symbol, sum(qty) AS open_interest FROM tape GROUP BY time_bucket(to_seconds(86400), event_time), trade_id % 5"


@register(
    "t8_regime",
    W(["tape"], """SELECT y.symbol, y.bucket_start, y.taker_delta, o.interest_change, CASE WHEN interest_change IS NULL OR interest_change = 0 OR taker_delta = 0 THEN 'unclassified' WHEN taker_delta > 0 AND interest_change > 0 THEN 'longs_opened' WHEN taker_delta > 0 THEN 'shorts_closed' WHEN interest_change > 0 THEN 'shorts_opened' ELSE 'longs_closed' END AS regime
 FROM (SELECT * FROM b WHERE market = 'um') AS y JOIN (SELECT symbol, bucket_start, CASE WHEN epoch_us(bucket_start) - epoch_us(lag(bucket_start) OVER w) = 86400000000 THEN open_interest - lag(open_interest) OVER w END AS interest_change FROM oi WINDOW w AS (PARTITION BY symbol ORDER BY bucket_start)) AS o ON o.symbol = y.symbol AND o.bucket_start = y.bucket_start""", {"b": V.bucket_sql("tape", 86400), "oi": INTEREST}),
    "taker_delta interest_change",
)
def _(spark, d):
    df = V.tape_raw(spark, d)
    buckets = tape.tape_buckets(df.where("market = 'um'"), "trades", 86400)
    days = latest(df, tape.keys("trades")).select(E.bucket_start(F.col("event_time"), 86400).alias("bucket_start"), F.concat(F.lit("S"), F.col("trade_id") % 5, F.lit("USDT")).alias("symbol"), "qty")
    return flow.regimes(buckets, days.groupBy("symbol", "bucket_start").agg(F.sum("qty").alias("open_interest")), 86400, ["symbol"])


@register(
    "t9_lead_lag",
    W(["tape"], """SELECT s.symbol, s.bucket_start, s.taker_delta AS spot_delta, s.x AS spot_expansion, u.taker_delta AS um_delta, u.x AS um_expansion, CASE WHEN s.x > u.x THEN 'spot' WHEN s.x < u.x THEN 'um' ELSE 'none' END AS leader FROM (SELECT *, volume / nullif(avg(volume) OVER (PARTITION BY market, symbol), 0) AS x FROM b) AS s
 JOIN (SELECT *, volume / nullif(avg(volume) OVER (PARTITION BY market, symbol), 0) AS x FROM b) AS u ON s.symbol = u.symbol AND s.bucket_start = u.bucket_start WHERE s.market = 'spot' AND u.market = 'um'""", HOURLY),
    "spot_delta spot_expansion um_delta um_expansion",
)
def _(spark, d):
    return flow.lead_lag(tape_buckets(spark, d))


@register("t10_wash_screen", W(["tape"], "SELECT *, net_delta / nullif(gross_delta, 0) AS net_over_gross FROM (SELECT market, symbol, price, sum(delta) AS net_delta, sum(abs(delta)) AS gross_delta, count(*) AS bucket_count, CAST(sum(trade_count) AS BIGINT) AS hit_count, sum(volume) AS volume FROM p GROUP BY market, symbol, price) AS x", {"u": UNIT, **WEEKLY}), "net_delta gross_delta volume net_over_gross")
def _(spark, d):
    return flow.wash_screen(_levels(spark, d))


@register(
    "t11_roundness",
    W(["tape"], "SELECT market, symbol, price, hit_count, roundness, hit_count / avg(hit_count) OVER (PARTITION BY market, symbol, roundness) AS hits_over_class_mean FROM (SELECT market, symbol, price, CAST(sum(trade_count) AS BIGINT) AS hit_count, CASE WHEN price % 10 = 0 THEN 3 ELSE 2 END AS roundness FROM p GROUP BY market, symbol, price) AS x", {"u": UNIT.replace("floor(price / 10) * 10", "floor(price)"), **WEEKLY}),
    "hits_over_class_mean",
)
def _(spark, d):
    df = latest(V.tape_raw(spark, d), tape.keys("trades")).withColumn("price", F.floor("price").cast("double"))
    return flow.roundness_baseline(tape.footprint(df, "trades", 86400, "1900-01-01T00:00:00Z", "2200-01-01T00:00:00Z"))


@register("t13_floor_p999", W(["tape"], "SELECT market, symbol, quantile_cont(price * qty, 0.999) AS notional_floor FROM tape GROUP BY market, symbol"), "notional_floor", 4)
def _(spark, d):
    return flow.notional_floor(V.tape_raw(spark, d), "trades")
