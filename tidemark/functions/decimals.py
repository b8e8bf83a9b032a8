"""Exact decimals of any length, kept as text. Spark's decimals end at 38 digits, so these are Arrow-batched Python."""

from __future__ import annotations

import re
from decimal import Context, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_EXPONENT = 64
_NUMBER = re.compile(r"-?\d+(\.\d+)?([eE][+-]?\d+)?")


def parse(text: str) -> tuple[int, int]:
    """A number as (units, scale): units / 10**scale. Exponents beyond MAX_EXPONENT are an error."""
    if not _NUMBER.fullmatch(text):
        raise ValueError(f"not a decimal number: {text}")
    mantissa, _, exponent = text.lower().partition("e")
    power = int(exponent or 0)
    if abs(power) > MAX_EXPONENT:
        raise ValueError(f"exponent out of range: {text}")
    sign, digits, places = Decimal(mantissa).as_tuple()
    units, scale = int("".join(map(str, digits))), -places - power
    if scale < 0:
        units, scale = units * 10**-scale, 0
    return (-units if sign else units), scale


def show(units: int, scale: int) -> str:
    """Plain digits with all of the scale's places."""
    number = Decimal(units).scaleb(-scale, Context(prec=len(str(abs(units))) + scale + 5, Emin=-(10**6), Emax=10**6))
    return f"{number:.{scale}f}"


def add(a: str, b: str) -> str:
    (x, p), (y, q) = parse(a), parse(b)
    scale = max(p, q)
    return show(x * 10 ** (scale - p) + y * 10 ** (scale - q), scale)


@F.pandas_udf(StringType())
def add_decimals(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sums, with the longer scale of the two; null where either is."""
    return pd.Series([None if x is None or y is None else add(x, y) for x, y in zip(a, b)], dtype=object)


def is_zero(number: Column | str) -> Column:
    """Whether a decimal text is exactly 0: all digits before an exponent are zeros. Null for null."""
    return (F.col(number) if isinstance(number, str) else number).rlike(r"^-?0+(\.0+)?([eE].*)?$")
