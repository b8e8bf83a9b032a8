"""Where the registered queries are kept, with their SQL where they have one."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import sql_round


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    #: Doubles that the SQL side rounds, which the Spark side rounds just so; it rounds all its doubles to as many digits.
    doubles: tuple[str, ...] = ()
    digits: int = 6


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    def add(f):
        QUERIES[name] = Query(f, sql, tuple(doubles.split()), digits)
        return f

    return add


def rounded(df: DataFrame, digits: int, as_sql: Sequence[str] = ()) -> DataFrame:
    way = lambda c: sql_round(F.col(c), digits) if c in as_sql else F.round(c, digits)
    return df.select(*[way(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, d, q=q: rounded(q.run(spark, d), q.digits, q.doubles)) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, q in QUERIES.items():
        if q.sql:
            again = ", ".join(f"round({c}, {q.digits}) AS {c}" for c in q.doubles)
            out[name] = f"SELECT * REPLACE ({again}) FROM ({q.sql}) AS q" if again else q.sql
    return out
