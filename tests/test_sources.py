import json
import threading
import time

import pytest

from tidemark.sources import files as S
from tidemark.sources import snapshots
from tidemark.sources.cache import FileCache, TtlCache
from tidemark.sources.profiles import ProfileStore
from tidemark.sources.rest import MarketReader
from tidemark.validate import InvalidArgument

REFUSED = "0.0.0.0 10.1.2.3 100.64.0.1 127.0.0.1 169.254.1.1 172.16.0.1 192.168.1.1 192.0.2.1 198.18.0.1 198.51.100.1 203.0.113.1 224.0.0.1 255.255.255.255 :: ::1 ::ffff:10.0.0.1 fc00::1 fe80::1 ff02::1 2001:db8::1".split()


@pytest.mark.parametrize("ip", REFUSED)
def test_private_addresses_are_refused(ip):
    assert S.refused_address(ip)


@pytest.mark.parametrize("ip", ["1.1.1.1", "8.8.8.8", "93.184.216.34", "2606:4700:4700::1111"])
def test_public_addresses_pass(ip):
    assert not S.refused_address(ip)


@pytest.mark.parametrize("url", ["http://a.com/x.csv", "https://u:p@a.com/x.csv", "https://a.com/x.exe", "https:///x.csv"])
def test_bad_urls(url):
    with pytest.raises(InvalidArgument):
        S.checked_url(url)


def test_paths_stay_inside(tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a").write_text("x")
    (tmp_path / "b").write_text("x")
    (root / "link").symlink_to(tmp_path / "b")
    assert S.inside(root, "a") == (root / "a").resolve()
    for bad in ("../b", "link", str(tmp_path / "b")):
        with pytest.raises(InvalidArgument):
            S.inside(root, bad)
    assert S.audit_url("https://a.com/x.csv?key=1#y") == "https://a.com/x.csv"
    S.verify(S.sha256(root / "a"), S.sha256(root / "a").upper())
    with pytest.raises(InvalidArgument):
        S.verify(S.sha256(root / "a"), "0" * 64)
    with pytest.raises(InvalidArgument):
        S.verify(S.sha256(root / "a"), "xyz")


@pytest.mark.parametrize("kind", ["memory", "file"])
def test_cache(kind, tmp_path):
    now = [100.0]
    make = lambda: TtlCache(2, lambda: now[0]) if kind == "memory" else FileCache(str(tmp_path / "c.db"), 2, lambda: now[0])
    c, calls = make(), []

    def load(v):
        calls.append(v)
        return v

    assert [c.get_or_load("a", 10, lambda: load(1)), c.get_or_load("a", 10, lambda: load(2))] == [1, 1]
    now[0] += 11
    assert c.get_or_load("a", 10, lambda: load(3)) == 3
    assert c.get_or_load("a", 0, lambda: load(4)) == 4
    c.get_or_load("b", 10, lambda: 5)
    c.get_or_load("d", 10, lambda: 6)
    assert c.get_or_load("a", 10, lambda: load(7)) == 7  # the oldest went
    with pytest.raises(ZeroDivisionError):
        c.get_or_load("e", 10, lambda: 1 / 0)
    if kind == "file":
        assert make().get_or_load("a", 10, lambda: load(8)) == 7


def test_one_load_at_a_time():
    c, calls = TtlCache(), []

    def load():
        calls.append(1)
        time.sleep(0.2)
        return 1

    threads = [threading.Thread(target=lambda: c.get_or_load("a", 10, load)) for _ in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(calls) == 1


def test_snapshots(spark):
    body = lambda s: spark.createDataFrame([(s,)], "body string")
    r = snapshots.klines(body('[[1,"2","3","1","2.5","9",10,"22",4,"x"]]')).first()
    assert (r["open_time"], r["close"], r["trade_count"]) == (1, 2.5, 4)
    with pytest.raises(Exception, match="finite"):
        snapshots.klines(body('[[1,"NaN","3","1","2.5","9",10,"22",4]]')).collect()
    with pytest.raises(Exception, match="few"):
        snapshots.klines(body("[[1,2]]")).collect()
    one = '{"symbol":"A","lastPrice":"1","priceChangePercent":"2","quoteVolume":"3","highPrice":"4","lowPrice":"5"}'
    assert snapshots.tickers(body(one)).count() == 1 and snapshots.tickers(body(f"[{one},{one}]")).count() == 2
    b = snapshots.order_books(body('{"symbol":"A","lastUpdateId":1,"bids":[["1","2"]],"asks":[["3","4"]]}')).first()
    assert b["bids"][0]["price"] == 1 and b["asks"][0]["qty"] == 4
    f = snapshots.funding_rates(body('[{"symbol":"A","fundingRate":"0.1","fundingTime":1},{"symbol":"A","fundingRate":"0.2","fundingTime":2,"markPrice":"7"}]')).collect()
    assert [x["mark_price"] for x in f] == [None, 7.0]
    i = snapshots.exchange_info(body('{"symbols":[{"symbol":"A","status":"T","baseAsset":"B","quoteAsset":"C","orderTypes":["L"],"filters":[{"k":"v","n":5,"o":{"x":1}}]}]}')).first()
    assert i["filters"] == [{"k": "v", "n": "5"}]
    with pytest.raises(Exception, match="one symbol"):
        snapshots.exchange_info(body('{"symbols":[]}')).collect()
    assert snapshots.open_interest(body('{"symbol":"A","openInterest":"5.5","time":1}')).first()["open_interest"] == 5.5
    assert snapshots.premium_index(body('{"symbol":"A","markPrice":"1","indexPrice":"2","estimatedSettlePrice":"3","lastFundingRate":"4","nextFundingTime":5,"time":6}')).first()["index_price"] == 2


def test_profiles(tmp_path):
    store = ProfileStore(tmp_path / "p.json")
    assert store.load() == [] and store.status() == []
    one = {"id": "a", "product": "spot", "environment": "testnet", "api_key": "k", "private_key_path": "/k.pem"}
    (tmp_path / "p.json").write_text(json.dumps([one, one | {"id": "b"}, one | {"id": "f", "product": "futures"}]))
    assert store.select("futures").id == "f" and store.select("spot", "b").id == "b"
    assert all("k" not in map(str, s.values()) and len(s) == 4 for s in store.status())
    with pytest.raises(InvalidArgument, match="more than one"):
        store.select("spot")
    with pytest.raises(InvalidArgument, match="none"):
        store.select("spot", "f")
    for bad in ({"extra": 1}, {"id": "a b"}, {"product": "x"}, {"private_key_path": "k.pem"}, {"default": "yes"}, {"api_key": ""}):
        (tmp_path / "p.json").write_text(json.dumps([one | bad]))
        with pytest.raises(InvalidArgument):
            store.load()


def test_reader_caches_by_request(spark):
    asked = []

    def fetch(path, params):
        asked.append((path, params["symbol"]))
        return '[[1,"2","3","1","2.5","9",10,"22",4]]'

    r = MarketReader(spark, fetch, {"candles": "/c"})
    assert [r.candles("btcusdt ", "1h").count(), r.candles("BTCUSDT", "1h").count(), r.candles("ETHUSDT", "1h").first()["close"]] == [1, 1, 2.5]
    assert asked == [("/c", "BTCUSDT"), ("/c", "ETHUSDT")]
    for bad in (lambda: r.candles("x", "1h"), lambda: r.candles("BTCUSDT", "2d"), lambda: r.candles("BTCUSDT", "1h", 0)):
        with pytest.raises(InvalidArgument):
            bad()
