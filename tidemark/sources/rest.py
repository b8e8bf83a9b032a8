"""Snapshots over a market's public interface: a fetch function in, typed tables out, answers cached by their request."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession

from .. import validate as V
from . import snapshots
from .cache import TtlCache

TIMEOUT = 10
#: Seconds that answers of each kind are kept; other kinds are always asked for.
TTL = {"ticker": 15, "candles": 60, "funding": 600}


def http_fetch(base_url: str) -> Callable[[str, dict], str]:
    V.need(base_url.startswith("https://"), "url: https is needed")

    def fetch(path: str, params: dict) -> str:
        query = urlencode({k: v for k, v in params.items() if v is not None})
        with urllib.request.urlopen(f"{base_url}{path}?{query}", timeout=TIMEOUT) as answer:
            return answer.read().decode()

    return fetch


class MarketReader:
    """paths says where each kind of answer is found: candles, ticker, book, info, premium, interest, funding."""

    def __init__(self, spark: SparkSession, fetch: Callable[[str, dict], str], paths: dict[str, str], cache: TtlCache | None = None, namespace: str = "spot"):
        self.spark, self.fetch, self.paths, self.cache, self.namespace = spark, fetch, paths, cache or TtlCache(), namespace

    def _body(self, kind: str, **params) -> DataFrame:
        key = f"{self.namespace}:{kind}:{urlencode(sorted((k, str(v)) for k, v in params.items() if v is not None))}"
        body = self.cache.get_or_load(key, TTL.get(kind, 0), lambda: self.fetch(self.paths[kind], params))
        return self.spark.createDataFrame([(body,)], "body string")

    def candles(self, symbol: str, interval: str, limit: int = 500) -> DataFrame:
        return snapshots.klines(self._body("candles", symbol=V.symbol(symbol), interval=V.interval(interval), limit=V.limit(limit)))

    def tickers(self, symbol: str | None = None) -> DataFrame:
        return snapshots.tickers(self._body("ticker", symbol=symbol and V.symbol(symbol)))

    def order_book(self, symbol: str, limit: int = 100) -> DataFrame:
        return snapshots.order_books(self._body("book", symbol=V.symbol(symbol), limit=V.limit(limit)))

    def exchange_info(self, symbol: str) -> DataFrame:
        return snapshots.exchange_info(self._body("info", symbol=V.symbol(symbol)))

    def premium_index(self, symbol: str) -> DataFrame:
        return snapshots.premium_index(self._body("premium", symbol=V.symbol(symbol)))

    def open_interest(self, symbol: str) -> DataFrame:
        return snapshots.open_interest(self._body("interest", symbol=V.symbol(symbol)))

    def funding_rates(self, symbol: str, limit: int = 100) -> DataFrame:
        return snapshots.funding_rates(self._body("funding", symbol=V.symbol(symbol), limit=V.limit(limit)))
