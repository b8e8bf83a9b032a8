"""Scans over blocks against plain loops, with blocks of a few rows and one symbol that has nearly all of them."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import candles, history, scan
from tidemark.plans import catalogue
from tidemark.plans import views as V


@pytest.fixture(params=[1 << 17, 40])
def rows_a_block(request, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK_ROWS", request.param)


def symbols(n, seed=1):
    r = random.Random(seed)
    return [r.choice(["HOT"] * 9 + ["A", None]) for _ in range(n)]


def test_places_and_totals(spark, rows_a_block):
    rows = [(s, i * 7919 % 1000, i, float(i % 5) if i % 11 else None) for i, s in enumerate(symbols(700))]
    df = spark.createDataFrame(rows, "s string, t long, id long, v double")
    order = [F.col("t"), F.col("id")]
    want_n, want_sum = {}, {}
    for s in {r[0] for r in rows}:
        total = 0.0
        for n, r in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: r[1:3])):
            total += r[3] or 0
            want_n[r[2]], want_sum[r[2]] = n, total
    assert {r.id: r.nth for r in scan.numbered(df, ["s"], order).collect()} == want_n
    assert {r.id: r.total for r in scan.running_total(df, "v", ["s"], order, "total").collect()} == want_sum
    assert scan.numbered(df.limit(0), ["s"], order).isEmpty()


def test_sessions(spark, rows_a_block):
    """Gaps and islands, equal times and one session of hundreds of rows; a gap of just the limit begins none."""
    r = random.Random(12)
    now, rows = 0, []
    for i, s in enumerate(symbols(900, 5)):
        now += r.choice([0, 0, 1, 2, 9, 10, 11]) if i < 450 else r.choice([0, 1])
        rows.append((s, now if i % 97 else None, i))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "s string, t long, id long")
    got = {x.id: x.session for x in scan.sessions(df, ["s"], "t", F.lit(10)).collect()}
    want = {}
    for s in {x[0] for x in rows}:
        n, last = 1, None
        for _, t, i in sorted((x for x in rows if x[0] == s), key=lambda x: (x[1] is not None, x[1] or 0)):
            n += t is not None and last is not None and t > last + 10
            last = t if t is not None else last
            want[i] = n
    assert got == want and len(set(want.values())) > 20


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_asof(spark, rows_a_block, strict, how):
    r = random.Random(2)
    left = [(s, r.choice([None, *range(400)]), i) for i, s in enumerate(symbols(600))] + [("HOT", 5, 600)] * 3
    right = [(s, r.choice([None, *range(0, 400, 3)]), r.randrange(4), i) for i, s in enumerate(symbols(300, 3))] + [("only", 1, 1, 999)]
    ldf = spark.createDataFrame(left, "s string, t long, id long")
    rdf = spark.createDataFrame(right, "s string, t long, rev long, id long")
    got = scan.asof_join(ldf, rdf, ["s"], "t", ties=["rev", "id"], how=how, strict=strict)
    assert got.columns == ["s", "t", "id", "right_t", "rev", "right_id"]
    want = []
    for s, t, i in left:
        fits = [x for x in right if x[0] == s and None not in (s, t, x[1]) and (x[1] < t or (x[1] == t and not strict))]
        best = max(fits, key=lambda x: x[1:], default=None)
        if best or how == "left":
            want.append((s, t, i, *(best[1:] if best else (None,) * 3)))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_asof_within(spark):
    times = lambda rows: spark.createDataFrame(rows, "s string, t timestamp_ntz, v int")
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1, h)
    out = scan.asof_join(times([("a", at(3), 1), ("a", at(9), 2)]), times([("a", at(2), 5)]), ["s"], "t", within=F.expr("interval 2 hours")).collect()
    assert sorted((r.v, r.right_v) for r in out) == [(1, 5), (2, None)]
    assert scan.asof_join(times([]), times([]), ["s"], "t").isEmpty()
    with pytest.raises(ValueError):
        scan.asof_join(times([]), times([]), ["s"], "t", how="outer")


def plain_history(c):
    """Lists of high, low, close to each candle's (sma20, ema20, rsi14, line, signal, atr14), by the latest-candle folds' rules."""
    close = [x[2] for x in c]

    def smooth(x, n, weight):
        out, y = [None] * len(x), None
        for i, v in enumerate(x):
            y = sum(x[:n]) / n if i == n - 1 else None if i < n - 1 else y * (1 - weight) + v * weight
            out[i] = y
        return out

    steps = list(zip(c, c[1:]))
    gain, loss = (smooth([max(0.0, k * (b[2] - a[2])) for a, b in steps], 14, 1 / 14) for k in (1, -1))
    ranges = smooth([max(b[0] - b[1], abs(b[0] - a[2]), abs(b[1] - a[2])) for a, b in steps], 14, 1 / 14)
    fast, slow = smooth(close, 12, 2 / 13), smooth(close, 26, 2 / 27)
    lines = [f - s for f, s in zip(fast[25:], slow[25:])]
    signal = smooth(lines, 9, 0.2)
    rsi = lambda g, l: None if g is None else 50.0 if g == l == 0 else 100.0 if l == 0 else 100 - 100 / (1 + g / l)
    out = []
    for i in range(len(c)):
        sig = signal[i - 25] if i >= 25 else None
        out.append((sum(close[i - 19 : i + 1]) / 20 if i >= 19 else None, smooth(close, 20, 2 / 21)[i], rsi(gain[i - 1], loss[i - 1]) if i else None, lines[i - 25] if sig is not None else None, sig, ranges[i - 1] if i else None))
    return out


def test_indicators_of_every_candle(spark, rows_a_block):
    r = random.Random(6)
    series = {"HOT": 230, "A": 36, "few": 14, "flat": 40, None: 21}
    rows = []
    for s, n in series.items():
        price = 100.0
        for i in range(n):
            price += 0 if s == "flat" else r.uniform(-3, 3)
            rows.append((s, i, price + r.random() * (s != "flat"), price - r.random() * (s != "flat"), price))
    df = spark.createDataFrame(rows, "symbol string, open_time long, high double, low double, close double")
    got = {(x.symbol, x.open_time): x for x in history.indicator_history(df.repartition(5), ["symbol"]).collect()}
    assert len(got) == len(rows)
    for s in series:
        for i, want in enumerate(plain_history([x[2:] for x in rows if x[0] == s])):
            x = got[s, i]
            assert (x.sma20, x.ema20, x.rsi14, x.macd_line, x.macd_signal, x.atr14) == pytest.approx(want, abs=2e-8), (s, i)
            assert x.middle_band == (None if x.sma20 is None else pytest.approx(x.sma20, abs=2e-8)) and (x.upper_band is None) == (x.sma20 is None)


def test_the_last_of_a_history_is_the_latest_candle_s(spark):
    r = random.Random(9)
    rows = [(i, 10 + r.random(), 9 - r.random(), 9 + r.random(), i + 1) for i in range(120)]
    df = spark.createDataFrame(rows, "open_time long, high double, low double, close double, close_time long").withColumn("symbol", F.lit("x"))
    last = history.indicator_history(df, ["symbol"]).orderBy(F.desc("open_time")).first()
    fold = candles.indicator_frame(df, ["symbol"]).first()
    assert (last.sma20, last.ema20, last.rsi14, last.atr14, last.macd_line, last.macd_signal, last.upper_band, last.lower_band) == pytest.approx((fold.sma20, fold.ema20, fold.rsi14, fold.atr14, fold.macd.line, fold.macd.signal, fold.bollinger20.upper, fold.bollinger20.lower), abs=2e-8)


def test_places_in_the_whole_footprint(spark, tmp_path, monkeypatch):
    """One order over all markets, symbols and days, in ranges of a few rows, with unknown prices, sizes and symbols."""
    monkeypatch.setattr(scan, "BLOCK_ROWS", 40)
    i = F.col("event_id")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumns(
        {"value": F.when(i % 5 != 0, F.floor("value")), "user_id": F.when(i % 11 != 0, F.col("user_id")), "props": F.when(i % 13 != 0, F.col("props"))}
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    sql = V.with_views(["tape"], f"SELECT market, symbol, bucket_start, price, row_number() OVER (ORDER BY market, symbol, bucket_start, volume DESC, price) AS place FROM ({V.level_sql('tape', 86400)}) AS x ORDER BY place")
    got = catalogue.queries()["d4_footprint_order"](spark, str(tmp_path)).orderBy("place").collect()
    assert [tuple(r) for r in got] == con.execute(sql).fetchall()
    assert [r["place"] for r in got] == list(range(1, len(got) + 1)) and len(got) > 500
