import datetime as dt
import functools
import math

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import decimals as D
from tidemark.functions import expressions as E
from tidemark.operators import account, candles, catalog, flow, market
from tidemark.plans import catalogue
from tidemark.validate import InvalidArgument


def candle_frame(spark, closes):
    rows = [("um", "BTCUSDT", i, float(c) + 1, float(c) - 2, float(c), i) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "market string, symbol string, open_time long, high double, low double, close double, close_time long")


def indicators(spark, closes):
    return candles.indicator_frame(candle_frame(spark, closes)).first()


def test_indicators_of_a_rising_series(spark):
    r = indicators(spark, [101 + i for i in range(40)])
    assert r["sma20"] == 130.5 and r["rsi14"] == 100 and r["status"]["macd"] == "ok"


def test_flat_series_has_rsi_50(spark):
    assert indicators(spark, [100] * 30)["rsi14"] == 50


def test_short_inputs(spark):
    r = indicators(spark, [100 + i for i in range(20)])
    assert r["ema20"] == r["sma20"] and r["status"]["ema20"] == "degraded"
    r = indicators(spark, [100 + i for i in range(14)])
    assert r["rsi14"] is None and r["sma20"] is None and r["status"]["rsi14"] == "insufficient_data"
    assert indicators(spark, range(33))["macd"] is None and indicators(spark, range(34))["macd"] is not None


def test_recursive_indicators_against_loops(spark):
    closes = [100 + 10 * math.sin(i / 3) + 0.5 * i for i in range(80)]
    r = indicators(spark, closes)

    def ema(x, n):
        out = [sum(x[:n]) / n]
        for v in x[n:]:
            out.append(v * 2 / (n + 1) + out[-1] * (1 - 2 / (n + 1)))
        return out

    line = [a - b for a, b in zip(ema(closes, 12)[14:], ema(closes, 26))]
    assert r["ema20"] == pytest.approx(ema(closes, 20)[-1]) and r["ema20"] != pytest.approx(r["sma20"])
    assert r["macd"]["line"] == pytest.approx(line[-1]) and r["macd"]["signal"] == pytest.approx(ema(line, 9)[-1])
    ranges = [max(3, abs(b + 1 - a), abs(b - 2 - a)) for a, b in zip(closes, closes[1:])]
    a = sum(ranges[:14]) / 14
    for x in ranges[14:]:
        a = (a * 13 + x) / 14
    assert r["atr14"] == pytest.approx(a)


def test_labels(spark):
    df = candle_frame(spark, [100 + i for i in range(30)]).withColumn("interval", F.lit("1h"))
    down = candle_frame(spark, [100 - i for i in range(30)]).withColumn("interval", F.lit("4h"))
    t = candles.trends(df).first()
    assert (t["trend"], t["momentum"]) == ("uptrend", "overbought")
    assert candles.multi_timeframe(df.unionByName(down), ["1h", "4h"]).first()["alignment"] == "mixed"
    assert candles.multi_timeframe(df, ["1h", "1d"]).first()["alignment"] == "bullish_aligned"
    with pytest.raises(InvalidArgument):
        candles.multi_timeframe(df, ["1h", "1h"])


def test_books_without_volume_have_no_ratio(spark):
    level = "array<struct<price:double,qty:double>>"
    book = spark.createDataFrame([("X", [(0.0, 0.0)], [(0.0, 0.0)])], f"symbol string, bids {level}, asks {level}")
    r = market.order_book_summary(book).first()
    assert (r["spread"], r["spread_percent"], r["bid_ask_imbalance"]) == (0, None, None)
    with pytest.raises(Exception, match="empty side"):
        market.order_book_summary(book.withColumn("asks", F.array().cast(level))).collect()
    p = spark.createDataFrame([("X", 100.0, 0.0, 0.0001)], "symbol string, mark_price double, index_price double, last_funding_rate double")
    r = market.mark_price(p).first()
    assert r["basis_percent"] is None and r["funding_rate_percent"] == pytest.approx(0.01)


def test_exact_decimals(spark):
    assert D.add("123456789012345.12345678", "0.00000002") == "123456789012345.12345680"
    assert D.add("1e-8", "2.5E-7") == "0.00000026" and D.add("-0.5", "0.25") == "-0.25" and D.add("1e3", "1") == "1001"
    with pytest.raises(ValueError):
        D.parse("1e65")
    df = spark.createDataFrame([("A", "1e-8", "2.5E-7"), ("B", "0.000", "-0e5"), ("C", "1e64", "0")], "asset string, free string, locked string")
    got = {r["asset"]: r["total"] for r in account.balances(df).collect()}
    assert got == {"A": "0.00000026", "C": "1" + "0" * 64}
    assert account.balances(df, include_zero=True).count() == 3
    with pytest.raises(Exception, match="not a decimal"):
        account.balances(spark.createDataFrame([("A", "x", "1")], df.schema)).collect()


def test_account_renamings(spark):
    income = spark.createDataFrame([("S", "T", "1", "A", "", 5, "9007199254740993", ""), ("S", "T", "1", "A", "", 6, "2", "7")], "symbol string, incomeType string, income string, asset string, info string, time long, tranId string, tradeId string")
    rows = account.income(income).orderBy("time").collect()
    assert [r["tradeId"] for r in rows] == [None, "7"] and rows[0]["transactionId"] == "9007199254740993"
    with pytest.raises(InvalidArgument):
        account.income(income, 2, 1)


@pytest.mark.parametrize("seconds", [7, 60, 1000, 3600, 50000, 80000, 86400])
def test_buckets_begin_at_the_origin(spark, seconds):
    df = spark.sql("select timestamp_ntz'2024-03-01 12:34:56.5' as t union all select timestamp_ntz'1999-05-05 01:02:03'")
    for r in df.select("t", E.bucket_start(F.col("t"), seconds).alias("b"), F.unix_micros(F.col("t").cast("timestamp")).alias("x"), F.unix_micros(E.bucket_start(F.col("t"), seconds).cast("timestamp")).alias("y")).collect():
        s = r["x"] // 1_000_000
        assert r["y"] == (s - (s - E.BUCKET_ORIGIN) % seconds) * 1_000_000


def test_long_coverage_lists_are_cut_and_counts_are_not(spark):
    days = spark.sql("select explode(sequence(date'2023-01-01', date'2025-12-31')) as d").withColumn("t", F.col("d").cast("timestamp_ntz"))
    files = days.where("d <> date'2025-06-19'").select(F.col("t").alias("min_event_time"), F.col("t").alias("max_event_time"))
    r = catalog.coverage(files).first()
    assert (r["expected_day_count"], r["covered_day_count"], len(r["covered_days"]), r["covered_days_truncated"], r["missing_days"], r["truncated"]) == (1096, 1095, 800, True, ["2025-06-19"], False)
    ends = files.where("min_event_time in (timestamp_ntz'2023-01-01 00:00:00', timestamp_ntz'2025-12-31 00:00:00')")
    r = catalog.coverage(ends).first()
    assert (r["missing_day_count"], len(r["missing_days"]), r["truncated"]) == (1094, 800, True)


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.999, 1.0])
def test_exact_quantiles(spark, share):
    df = spark.range(60000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 == 0, 5.0).otherwise(F.pmod(F.hash("id"), F.lit(9973)).cast("double")).alias("v"))
    got = {r["g"]: r["q"] for r in flow.exact_quantile(df, "v", share, ["g"], "q").collect()}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", share).alias("q")).collect()}
    assert got == pytest.approx(want)


def test_floor_is_the_sql_to_the_last_digit(spark, tmp_path):
    """Groups whose floor ends at a half of the last digit kept: in the first a step of the interpolation decides, in the
    second the rounding. Then one with a null key, one of one row and one without a value."""
    pairs = {0: (35162, 13775.3, 13782.15), 1: (10784, 14300.46, 14300.61), None: (1500, 10.0, 11.0), 3: (1, 7.77, 7.77), 4: (3, None, None)}
    each = []
    for user, (n, a, z) in pairs.items():
        value = lambda v: F.lit(v).cast("double")
        at = F.when(F.col("i") <= math.floor(0.999 * (n - 1)), value(a)).otherwise(value(z))
        each.append(spark.range(n).withColumnRenamed("id", "i").select(F.lit(user).cast("long").alias("user_id"), at.alias("value"), "i"))
    rows = functools.reduce(DataFrame.unionByName, each)
    # No number is divisible by 7, so none was published again.
    number = 7 * (F.col("i") + 100_000 * F.coalesce("user_id", F.lit(9))) + 1
    rows.select(number.alias("event_id"), F.lit("view").alias("event_type"), F.lit('{"k": 1}').alias("props"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"), "user_id", "value").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    names = "market symbol notional_floor".split()
    want = {r[:2]: r[2] for r in con.execute(f"select {', '.join(names)} from ({catalogue.oracle_sql()['t13_floor_p999']})").fetchall()}
    got = {tuple(r)[:2]: r["notional_floor"] for r in catalogue.queries()["t13_floor_p999"](spark, str(tmp_path)).select(*names).collect()}
    assert got == want and len(want) == 5 and want["spot", "S4USDT"] is None
    exact = {r[0]: r[1] for r in con.execute("select user_id, quantile_cont(value, 0.999) from events group by user_id").fetchall()}
    assert {r["user_id"]: r["q"] for r in flow.exact_quantile(rows, "value", 0.999, ["user_id"], "q").collect()} == exact


def test_sql_rounds_halves_away_from_zero(spark):
    values = [0.5, 1.5, 2.5, -0.5, -1.5, 14300.492549999999, 1.00005, 0.00004999, -0.00001, 0.0, 1e300, -1e305, 1.7e308, math.inf, None]
    got = [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "v double").select(E.sql_round(F.col("v"), 0), E.sql_round(F.col("v"), 4)).collect()]
    assert got == [duckdb.execute("select round(?::double, 0), round(?::double, 4)", [v, v]).fetchone() for v in values]
    assert "-0.0" not in str(got)
