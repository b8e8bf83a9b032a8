"""Checks of arguments, made before anything is read: a bad one is refused and never ignored."""

from __future__ import annotations

import math
import re

MAX_SAFE = 2**53 - 1
TAPE_DATASETS, SERIES_DATASETS, TAPE_MARKETS = ("trades", "aggtrades"), ("metrics", "bookdepth"), ("spot", "um")
INTERVALS = ("1m", "3m", "5m", "15m", "30m", "1h", "2h", "4h", "6h", "8h", "12h", "1d", "3d", "1w", "1M")
MAX_ROWS, MAX_BUCKET_SECONDS = 5000, 86400
_LABEL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}")
_SYMBOL = re.compile(r"[A-Z0-9]{5,30}")


class InvalidArgument(ValueError):
    pass


def need(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidArgument(message)


def number(value, name: str, integer: bool = False, minimum: float | None = None):
    """A finite number of at most 2**53 - 1, not below the minimum."""
    need(isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value), f"{name}: a finite number is needed")
    need(not integer or float(value).is_integer(), f"{name}: an integer is needed")
    need(abs(value) <= MAX_SAFE, f"{name}: too large")
    need(minimum is None or value >= minimum, f"{name}: must be {minimum} or more")
    return value


def label(value: str, name: str) -> str:
    """A partition value: letters, digits, dot, underscore and dash."""
    need(isinstance(value, str) and bool(_LABEL.fullmatch(value)) and ".." not in value, f"{name}: not a valid label")
    return value


def symbol(value: str) -> str:
    out = value.strip().upper()
    need(bool(_SYMBOL.fullmatch(out)), "symbol: 5 to 30 letters or digits are needed")
    return out


def interval(value: str) -> str:
    need(value in INTERVALS, f"interval: one of {', '.join(INTERVALS)}")
    return value


def limit(value: int, most: int | None = None) -> int:
    number(value, "limit", integer=True, minimum=1)
    need(most is None or value <= most, f"limit: at most {most}")
    return value


def tape_selection(dataset: str, market: str) -> None:
    need(dataset in TAPE_DATASETS, "dataset: trades or aggtrades")
    need(market in TAPE_MARKETS, "market: spot or um")


def tape_filters(dataset: str, mode: str, start=None, end=None, min_price=None, max_price=None, min_notional=None, min_span=None, bucket_seconds=None) -> None:
    """Which filters go with which mode: rows, buckets or prices."""
    need(mode in ("rows", "buckets", "prices"), "mode: rows, buckets or prices")
    if bucket_seconds is not None:
        number(bucket_seconds, "bucket_seconds", integer=True, minimum=1)
        need(bucket_seconds <= MAX_BUCKET_SECONDS, f"bucket_seconds: at most {MAX_BUCKET_SECONDS}")
    need((mode == "rows") == (bucket_seconds is None), "bucket_seconds: needed by buckets and prices, refused by rows")
    if min_notional is not None:
        number(min_notional, "min_notional", minimum=0)
        need(mode != "prices", "min_notional: not with price levels")
    if min_span is not None:
        need(dataset == "aggtrades", "min_span: only aggregate trades have a span")
        number(min_span, "min_span", integer=True, minimum=1)
        need(mode == "rows", "min_span: only with rows")
    need(mode != "prices" or (start is not None and end is not None), "prices: start and end are both needed")
    for name, value in (("min_price", min_price), ("max_price", max_price)):
        if value is not None:
            number(value, name, minimum=0)
    need(min_price is None or max_price is None or min_price <= max_price, "min_price: above max_price")


def series_filters(dataset: str, percentage=None, bucket_seconds=None) -> None:
    need(dataset in SERIES_DATASETS, "dataset: metrics or bookdepth")
    if percentage is not None:
        number(percentage, "percentage")
        need(dataset == "bookdepth", "percentage: only book depth has bands")
    if bucket_seconds is not None:
        number(bucket_seconds, "bucket_seconds", integer=True, minimum=1)


def unique(values: list[str], name: str, least: int, most: int) -> list[str]:
    need(least <= len(values) <= most and len(set(values)) == len(values), f"{name}: {least} to {most} different ones")
    return values
