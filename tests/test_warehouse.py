import dataclasses
import datetime as dt
import zipfile
from pathlib import Path

import pytest

from tidemark.operators import sketches
from tidemark.sources.warehouse import Warehouse
from tidemark.validate import InvalidArgument

DAY = dt.datetime(2025, 3, 14)


def ticks(t, per_second):
    return round((t - dt.datetime(1970, 1, 1)).total_seconds() * per_second)


@dataclasses.dataclass
class Trade:
    id: int
    price: float
    qty: float
    time: dt.datetime
    maker: bool = False
    orders: int = 1

    @property
    def notional(self):
        return self.price * self.qty

    @property
    def signed(self):
        return -self.qty if self.maker else self.qty


def text_of(*rows, header=""):
    return header + "".join(",".join(map(str, r)) + "\n" for r in rows)


def spot(*trades):
    """Seven columns without a header, microseconds."""
    return text_of(*[(t.id, t.price, t.qty, t.notional, ticks(t.time, 10**6), t.maker, True) for t in trades])


def um(*trades):
    """Six columns with a header, milliseconds."""
    return text_of(*[(t.id, t.price, t.qty, t.notional, ticks(t.time, 1000), str(t.maker).lower()) for t in trades], header="id,price,qty,quote_qty,time,is_buyer_maker\n")


def agg(*trades):
    return text_of(*[(t.id, t.price, t.qty, 50 * t.id, 50 * t.id + t.orders - 1, ticks(t.time, 10**6), t.maker, True) for t in trades])


def agg_um(*trades):
    return text_of(*[(t.id, t.price, t.qty, 50 * t.id, 50 * t.id + t.orders - 1, ticks(t.time, 1000), str(t.maker).lower()) for t in trades], header="agg_trade_id,price,quantity,first_trade_id,last_trade_id,transact_time,is_buyer_maker\n")


def kline(open_time, per_second, o, h, low, c, volume):
    end = ticks(open_time + dt.timedelta(hours=1), per_second) - 1
    return ticks(open_time, per_second), o, h, low, c, volume, end, volume * c, 7, volume / 2, volume * c / 2, 0


def hour(n, **more):
    return DAY + dt.timedelta(hours=n, **more)


#: The first candle's times are milliseconds, the second one's microseconds.
CANDLES = [kline(hour(22), 1000, 31.5, 33, 31, 32.25, 8), kline(hour(23), 10**6, 32.25, 32.5, 30, 30.75, 12)]
KLINES = text_of(*CANDLES)
FIRST, SECOND = Trade(501, 31.25, 4.0, hour(9, microseconds=417003)), Trade(502, 31.5, 2.5, hour(9, minutes=12, seconds=8), maker=True)
SPOT = spot(FIRST, SECOND)
#: The archive again: the first trade at another price, and one more trade between the two.
MENDED, BETWEEN = dataclasses.replace(FIRST, price=31.75), Trade(503, 32.0, 1.5, hour(9, minutes=3))
AGAIN = spot(MENDED, SECOND, BETWEEN)
UM_TRADES = [Trade(501, 33.25, 6.0, hour(9)), Trade(502, 33.5, 0.5, hour(9, minutes=1), maker=True)]
UM = um(*UM_TRADES)
SMALL, LARGE = Trade(81, 31.25, 3.0, hour(9, seconds=5), orders=6), Trade(82, 31.5, 4000.0, hour(9, minutes=2, seconds=30), maker=True, orders=9)
AGG, AGG_UM, BIG = agg(SMALL), agg_um(SMALL), agg(LARGE)
LATER = spot(Trade(700, 40.5, 1.0, DAY + dt.timedelta(days=18, hours=4)))
OPEN_INTEREST = [8125.5, 8060.25]
METRICS = text_of(
    *[(hour(6, minutes=5 * i), "BTCUSDT", oi, oi * 31.5, 1.25 + i, 1.5 + i, 1.75 + i, 0.5 + i) for i, oi in enumerate(OPEN_INTEREST)],
    header="create_time,symbol,sum_open_interest,sum_open_interest_value,count_toptrader_long_short_ratio,sum_toptrader_long_short_ratio,count_long_short_ratio,sum_taker_long_short_vol_ratio\n",
)
BANDS = [-0.5, 0.5, 2.0]
DEPTH = text_of(*[(hour(6, seconds=40 * i), band, 60.0 + i, 1900.0 * (i + 1)) for i in range(2) for band in BANDS], header="timestamp,percentage,depth,notional\n")


@pytest.fixture
def house(spark, tmp_path):
    return Warehouse(spark, tmp_path / "house", [tmp_path])


def put(house, tmp_path, text, profile, name="in.csv", **labels):
    path = tmp_path / name
    path.write_text(text)
    return house.import_file(path, profile, source="test", symbol="btcusdt", **labels)


def trades(house, tmp_path, text, market="spot", dataset="trades", name="in.csv"):
    return put(house, tmp_path, text, dataset, name, dataset=dataset, market=market)


def test_klines_and_duplicates(house, tmp_path):
    labels = {"dataset": "klines", "interval": "1h"}
    first = put(house, tmp_path, KLINES, "kline", **labels)
    assert (first["row_count"], first["duplicate"]) == (2, False)
    again = put(house, tmp_path, KLINES, "kline", **labels)
    assert again["duplicate"] and again["import_id"] == first["import_id"]
    rows = house.query_candles("klines", "BTCUSDT", "1h").collect()
    assert [(r["open_time"], r["close"]) for r in rows] == [(hour(23), CANDLES[1][4]), (hour(22), CANDLES[0][4])]
    # The bound is between the two candles, written with an offset.
    assert house.query_candles("klines", "BTCUSDT", "1h", start="2025-03-14T20:15:00-02:30").count() == 1
    assert house.data_range("klines", "BTCUSDT", interval="1h")["row_count"] == 2
    files = house.files().collect()
    assert [(f["year"], f["month"], f["row_count"]) for f in files] == [(DAY.year, DAY.month, 2)]


def test_candles_of_two_markets_collapse_without_a_market(house, tmp_path):
    for market, close in (("spot", 1.5), ("um", 2.5)):
        rows = text_of(*[(*c[:4], close, *c[5:]) for c in CANDLES])
        put(house, tmp_path, rows, "kline", dataset="klines", interval="1h", market=market)
    assert [r["close"] for r in house.query_candles("klines", "BTCUSDT", "1h").collect()] == [2.5, 2.5]
    assert [r["close"] for r in house.query_candles("klines", "BTCUSDT", "1h", market="spot").collect()] == [1.5, 1.5]


def test_spot_and_um_ids_are_apart(house, tmp_path):
    trades(house, tmp_path, SPOT)
    trades(house, tmp_path, UM, "um")
    r = house.data_range("trades", "BTCUSDT", "spot")
    assert (r["row_count"], r["min_time"], r["max_time"]) == (2, FIRST.time, SECOND.time)
    rows = house.query_trades("trades", "um", "BTCUSDT").collect()
    assert [r["price"] for r in rows] == [t.price for t in UM_TRADES[::-1]] and rows[0]["is_best_match"] is None


@pytest.mark.parametrize("text,market,dataset", [(SPOT, "um", "trades"), (UM, "spot", "trades"), (AGG, "um", "aggtrades"), (AGG_UM, "spot", "aggtrades")])
def test_a_wrong_market_fails(house, tmp_path, text, market, dataset):
    with pytest.raises(Exception):
        trades(house, tmp_path, text, market, dataset)
    assert house.status()["jobs"] == {"failed": 1} and house.files().count() == 0


def test_republished_archive(house, tmp_path):
    trades(house, tmp_path, SPOT)
    trades(house, tmp_path, AGAIN)
    now = [MENDED, BETWEEN, SECOND]
    rows = house.query_trades("trades", "spot", "BTCUSDT").collect()
    assert [(r["trade_id"], r["price"]) for r in rows] == [(t.id, t.price) for t in now[::-1]]
    (b,) = house.query_trades("trades", "spot", "BTCUSDT", bucket_seconds=3600).collect()
    assert (b["trade_count"], b["open"], b["close"]) == (3, MENDED.price, SECOND.price)
    volume, quote = sum(t.qty for t in now), sum(t.notional for t in now)
    bought = sum(t.qty for t in now if not t.maker)
    for name, value in {"volume": volume, "quote_volume": quote, "vwap": quote / volume, "taker_buy_volume": bought, "taker_sell_volume": volume - bought}.items():
        assert b[name] == pytest.approx(value)


def test_filters_come_before_the_latest_revision(house, tmp_path):
    trades(house, tmp_path, SPOT)
    trades(house, tmp_path, AGAIN)
    rows = house.query_trades("trades", "spot", "BTCUSDT", min_price=FIRST.price - 0.1, max_price=FIRST.price + 0.1).collect()
    assert [r["price"] for r in rows] == [FIRST.price]


def test_buckets_floor_cvd_and_footprint(house, tmp_path):
    trades(house, tmp_path, AGG, dataset="aggtrades", name="a.csv")
    trades(house, tmp_path, BIG, dataset="aggtrades", name="b.csv")
    both, floor = [SMALL, LARGE], 50_000
    ask = lambda **k: house.query_trades("aggtrades", "spot", "BTCUSDT", **k).collect()
    assert [r["span"] for r in ask()] == [t.orders for t in both[::-1]]
    assert [r["agg_trade_id"] for r in ask(min_notional=floor)] == [t.id for t in both if t.notional >= floor] == [LARGE.id]
    b = ask(bucket_seconds=60)
    assert [r["taker_delta"] for r in b] == [t.signed for t in both] and [r["cvd"] for r in b] == pytest.approx([SMALL.signed, SMALL.signed + LARGE.signed])
    late = ask(bucket_seconds=60, start=f"{hour(9, minutes=1).isoformat()}Z")
    assert [r["cvd"] for r in late] == [LARGE.signed]
    assert [r["large_trade_count"] for r in ask(bucket_seconds=60, min_notional=floor)] == [0, 1]
    assert [r["large_trade_notional"] for r in ask(bucket_seconds=60, min_notional=floor)] == [None, LARGE.notional]
    levels = ask(bucket_seconds=3600, by_price=True, start=f"{DAY.isoformat()}Z", end=f"{hour(24).isoformat()}Z")
    assert [(r["price"], r["delta"]) for r in levels] == [(t.price, t.signed) for t in sorted(both, key=lambda t: -t.qty)]
    with pytest.raises(Exception, match="more than 1"):
        ask(bucket_seconds=60, limit=1)


def test_an_empty_bucket_has_no_imbalance(house, tmp_path):
    trades(house, tmp_path, agg(dataclasses.replace(SMALL, qty=0)), dataset="aggtrades")
    b = house.query_trades("aggtrades", "spot", "BTCUSDT", bucket_seconds=60).collect()[0]
    assert (b["volume"], b["taker_delta"], b["taker_imbalance"], b["vwap"]) == (0, 0, None, None)


def test_files_are_pruned_and_gaps_counted(house, tmp_path):
    trades(house, tmp_path, SPOT, name="a.csv")
    trades(house, tmp_path, LATER, name="b.csv")
    c = house.coverage("trades")
    assert (c["covered_day_count"], c["missing_day_count"], c["expected_day_count"]) == (2, 17, 19)
    # A window selects files, not rows.
    assert house.data_range("trades", "BTCUSDT", "spot", start=f"{hour(9, minutes=5).isoformat()}Z", end=f"{hour(9, minutes=6).isoformat()}Z")["row_count"] == 2
    assert house.data_range("trades", "BTCUSDT", "spot", start="2025-06-01T00:00:00Z")["row_count"] == 0


def test_series(house, tmp_path):
    put(house, tmp_path, METRICS, "metrics", "m.csv", dataset="metrics", market="um")
    put(house, tmp_path, DEPTH, "bookdepth", "d.csv", dataset="bookdepth", market="um")
    m = house.query_series("metrics", "BTCUSDT", bucket_seconds=3600).collect()[0]
    assert m["sum_open_interest_avg"] == pytest.approx(sum(OPEN_INTEREST) / 2)
    assert m["sum_open_interest_last"] == OPEN_INTEREST[-1] and m["sum_open_interest_min"] == min(OPEN_INTEREST)
    assert house.query_series("bookdepth", "BTCUSDT").count() == 2 * len(BANDS)
    assert house.query_series("bookdepth", "BTCUSDT", percentage=BANDS[0]).count() == 2
    bands = house.query_series("bookdepth", "BTCUSDT", bucket_seconds=86400).collect()
    assert [b["percentage"] for b in bands] == BANDS


def test_generic_csv_zip_and_parquet(house, spark, tmp_path):
    put(house, tmp_path, "event_time,symbol,mood\n2025-03-14T09:00:00Z,BTCUSDT,0.125\n", "generic-csv", dataset="moods")
    path = house.files().first()["path"]
    row = spark.read.parquet(path).first()
    assert row["mood"] == 0.125 and row["_warehouse_import_id"]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.csv", SPOT)
    assert house.import_file(tmp_path / "z.zip", "trades", dataset="trades", source="t", market="spot", symbol="BTCUSDT")["row_count"] == 2
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("x.csv", SPOT)
        z.writestr("y.csv", SPOT)
    with pytest.raises(InvalidArgument, match="2 CSV"):
        house.import_file(tmp_path / "two.zip", "trades", dataset="trades", source="t2", market="spot", symbol="BTCUSDT")
    assert house.import_file(tmp_path / "two.zip", "trades", dataset="trades", source="t3", market="spot", symbol="BTCUSDT", zip_entry="y.csv")["row_count"] == 2
    assert house.import_file(path, "parquet", dataset="copy", source="t")["row_count"] == 1


@pytest.mark.parametrize(
    "call",
    [
        lambda h: h.query_trades("klines", "spot", "BTCUSDT"),
        lambda h: h.query_trades("trades", "cm", "BTCUSDT"),
        lambda h: h.query_trades("trades", "spot", "BTCUSDT", min_span=2),
        lambda h: h.query_trades("aggtrades", "spot", "BTCUSDT", min_span=2, bucket_seconds=60),
        lambda h: h.query_trades("trades", "spot", "BTCUSDT", bucket_seconds=60, by_price=True),
        lambda h: h.query_trades("trades", "spot", "BTCUSDT", by_price=True, start="2026-01-01T00:00:00Z", end="2026-01-02T00:00:00Z"),
        lambda h: h.query_trades("trades", "spot", "BTCUSDT", min_price=2, max_price=1),
        lambda h: h.query_trades("trades", "spot", "BTCUSDT", min_notional=float("nan")),
        lambda h: h.query_trades("trades", "spot", "BTCUSDT", limit=0),
        lambda h: h.query_trades("trades", "spot", "BTCUSDT", limit=5001),
        lambda h: h.query_series("metrics", "BTCUSDT", bucket_seconds=86401),
        lambda h: h.query_series("metrics", "BTCUSDT", percentage=1.0),
        lambda h: h.query_series("bookdepth", "BTCUSDT", percentage=float("inf")),
        lambda h: h.query_series("metrics", "BTCUSDT", bucket_seconds=0),
        lambda h: h.query_series("metrics", "BTCUSDT", market="spot"),
        lambda h: h.check("kline", "klines", "s"),
        lambda h: h.check("trades", "aggtrades", "s", "spot", "BTCUSDT"),
        lambda h: h.check("metrics", "metrics", "s", "spot", "BTCUSDT"),
        lambda h: h.check("trades", "trades", "s", "spot", "BTCUSDT", interval="1h"),
        lambda h: h.check("trades", "trades", "s", "spot", "BTCUSDT", has_header=True),
        lambda h: h.check("trades", "trades", "../x", "spot", "BTCUSDT"),
    ],
)
def test_bad_arguments_are_refused(house, call):
    with pytest.raises(InvalidArgument):
        call(house)


def test_nothing_imported_gives_nothing(house):
    for df in (house.query_trades("trades", "spot", "BTCUSDT"), house.query_trades("aggtrades", "um", "BTCUSDT", bucket_seconds=60), house.query_series("metrics", "BTCUSDT"), house.query_candles("klines", "BTCUSDT", "1h")):
        assert df.columns and df.count() == 0
    assert house.list_datasets().count() == house.list_files().count() == 0
    assert house.data_range("trades", "BTCUSDT", "spot")["row_count"] == 0
    assert house.coverage("trades")["covered_day_count"] == 0
    assert house.status()["file_count"] == 0


def test_only_import_roots_are_read(house, spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out.csv").write_text(SPOT)
    (tmp_path / "in/link.csv").symlink_to(tmp_path / "out.csv")
    labels = {"dataset": "trades", "source": "t", "market": "spot", "symbol": "BTCUSDT"}
    narrow = Warehouse(spark, (tmp_path / "narrow").as_uri(), [tmp_path / "none", (tmp_path / "in").as_uri()])
    for path in (tmp_path / "out.csv", tmp_path / "in/link.csv", tmp_path / "in/../out.csv", tmp_path / "in/nothing.csv"):
        with pytest.raises(InvalidArgument):
            narrow.import_file(path, "trades", **labels)
    with pytest.raises(InvalidArgument, match="no import root"):
        Warehouse(spark, tmp_path / "bare").import_file(tmp_path / "out.csv", "trades", **labels)
    with pytest.raises(InvalidArgument, match="mounted"):
        Warehouse(spark, "s3a://bucket/x")
    (tmp_path / "in/there.csv").write_text(SPOT)
    assert narrow.import_file("there.csv", "trades", **labels)["row_count"] == 2
    s = narrow.status()
    assert (s["jobs"], s["import_roots"][1], s["max_import_bytes"]) == ({"completed": 1}, str(tmp_path / "in"), narrow.max_bytes)
    assert [r["file_count"] for r in narrow.list_datasets().collect()] == [1] and narrow.list_files(5, market="spot").count() == 1


def test_deleted_files_cover_nothing(house, tmp_path):
    trades(house, tmp_path, SPOT, name="a.csv")
    later = trades(house, tmp_path, LATER, name="b.csv")
    assert house.coverage("trades")["covered_day_count"] == 2
    for r in house.files().where(f"import_id = '{later['import_id']}'").collect():
        Path(r["path"]).unlink()
    c = house.coverage("trades")
    assert (c["covered_day_count"], c["missing_day_count"], c["first_day"], c["last_day"]) == (1, 0, DAY.date(), DAY.date())
    assert house.query_trades("trades", "spot", "BTCUSDT").count() == 2


def test_quantiles_need_no_data_files(house, tmp_path):
    """Ten thousand trades in two files and a republished part: every quantile within the stated error, from the catalog alone."""
    rows = [Trade(k, 1 + (k * 7919 % 10007) / 16, 1.0, DAY + dt.timedelta(seconds=k)) for k in range(10_000)]
    for name, some in (("a", rows[:7000]), ("b", rows[7000:]), ("c", rows[:500])):
        trades(house, tmp_path, spot(*some), name=f"{name}.csv")
    trades(house, tmp_path, um(*rows[:20]), "um", name="d.csv")
    (tmp_path / "house/data").rename(tmp_path / "away")
    shares = [0, 0.5, 0.9, 0.999, 1]
    told = {r["market"]: r for r in house.notional_quantiles("trades", shares).collect()}
    values = sorted(t.notional for t in rows + rows[:500])
    for share, value in zip(shares, told["spot"]["quantiles"]):
        low, high = (sum(f(v) for v in values) / len(values) for f in (lambda v: v < value, lambda v: v <= value))
        assert low - sketches.RANK_ERROR <= share <= high + sketches.RANK_ERROR
    assert told["spot"]["row_count"] == 10_500 and told["spot"]["trade_count"] == pytest.approx(10_000, rel=0.025)
    assert told["um"]["quantiles"][-1] == max(t.notional for t in rows[:20]) and told["um"]["trade_count"] == 20
    late = house.notional_quantiles("trades", [1], start=f"{(DAY + dt.timedelta(seconds=9000)).isoformat()}Z").collect()
    assert [(r["market"], r["row_count"]) for r in late] == [("spot", 3000)]
    assert house.notional_quantiles("trades", [1], symbol="NONEUSDT").isEmpty()
    for bad in (("klines", [0.5]), ("trades", []), ("trades", [1.5])):
        with pytest.raises(InvalidArgument):
            house.notional_quantiles(*bad)
