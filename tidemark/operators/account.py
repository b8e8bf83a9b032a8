"""Account records: exact sums, exact zero filters and renamings. Amounts are decimal text throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decimals import add_decimals, is_zero
from ..validate import need

NUMERIC = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"
INTEGER = r"^-?\d+$"


def numeric(name: str, pattern: str = NUMERIC, what: str = "decimal number") -> Column:
    """The column, or an error when it runs if it is no decimal number."""
    c = F.col(name).cast("string")
    bad = F.raise_error(F.concat(F.lit(f"{name} is not a {what}: "), F.coalesce(c, F.lit("null"))))
    return F.when(c.rlike(pattern), c).otherwise(bad)


def present(name: str) -> Column:
    """The column, or an error when it runs if it is null."""
    return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(f"{name} is missing")))


def checked(rows: DataFrame, amounts: str, ids: str = "", others: str = "") -> DataFrame:
    """rows, whose amounts are decimal texts, whose ids are integers and whose other fields are there; a name that ends
    in ? may be missing or null, an id also empty. Nothing that does not fit is passed on."""
    made = {}
    for names, check in ((amounts, numeric), (ids, lambda c: numeric(c, INTEGER, "whole number")), (others, present)):
        for item in names.split():
            name, optional = item.rstrip("?"), item.endswith("?")
            if optional and name not in rows.columns:
                continue
            none = F.col(name).isNull() | (F.col(name).cast("string") == "")
            made[name] = F.when(none, F.col(name).cast("string")).otherwise(check(name)) if optional else check(name)
    return rows.withColumns(made)


def balances(rows: DataFrame, include_zero: bool = False) -> DataFrame:
    """asset, free, locked and their exact total; accounts without any of an asset are left out."""
    keep = [c for c in rows.columns if c not in ("free", "locked")]
    out = checked(rows, "free locked", others="asset").select(*keep, "free", "locked")
    out = out.withColumn("total", add_decimals("free", "locked"))
    return out if include_zero else out.where(~is_zero("total"))


def same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


#: The fields of each record, in order, and what they are named here.
POSITION = {
    **same("symbol", "positionSide"),
    "positionAmt": "positionAmount",
    **same("entryPrice", "breakEvenPrice", "markPrice"),
    "unRealizedProfit": "unrealizedProfit",
    **same("liquidationPrice", "leverage", "marginType", "isolatedMargin", "notional", "updateTime"),
}
ORDER = {
    **same("symbol", "orderId", "clientOrderId", "side", "positionSide", "type", "status", "timeInForce", "price"),
    "origQty": "originalQuantity",
    "executedQty": "executedQuantity",
    **same("stopPrice", "reduceOnly", "closePosition", "time", "updateTime"),
}
INCOME = {**same("symbol", "incomeType", "income", "asset", "info", "time"), "tranId": "transactionId", "tradeId": "tradeId"}
#: Fields that an answer may lack.
OPTIONAL = {"breakEvenPrice", "notional", "tradeId"}


def renamed(rows: DataFrame, names: dict[str, str], text: tuple[str, ...] = ()) -> DataFrame:
    out = []
    for before, after in names.items():
        c = F.col(before) if before in rows.columns or before not in OPTIONAL else F.lit(None).cast("string")
        out.append((c.cast("string") if before in text else c).alias(after))
    return rows.select(*out)


def positions(rows: DataFrame, include_flat: bool = False) -> DataFrame:
    amounts = "positionAmt entryPrice breakEvenPrice? markPrice unRealizedProfit liquidationPrice leverage isolatedMargin notional?"
    out = renamed(checked(rows, amounts, others="symbol marginType positionSide updateTime"), POSITION)
    return out if include_flat else out.where(~is_zero("positionAmount"))


def open_orders(rows: DataFrame) -> DataFrame:
    """Ids as text, so none loses digits."""
    others = "symbol clientOrderId status timeInForce type side positionSide reduceOnly closePosition time updateTime"
    return renamed(checked(rows, "price origQty executedQty stopPrice", "orderId", others), ORDER, ("orderId",))


def income(rows: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Entries from start to end in epoch milliseconds; an empty trade id is none."""
    need(start is None or end is None or start <= end, "start: later than end")
    if start is not None:
        rows = rows.where(F.col("time") >= start)
    if end is not None:
        rows = rows.where(F.col("time") <= end)
    rows = checked(rows, "income", "tranId tradeId?", "symbol incomeType asset info time")
    return renamed(rows, INCOME, ("tranId", "tradeId")).withColumn("tradeId", F.nullif("tradeId", F.lit("")))


def profiles(rows: DataFrame) -> DataFrame:
    """Profiles without anything secret: what is not named here is never selected."""
    return rows.select("profileId", "product", "environment", F.col("isDefault").cast("boolean").alias("isDefault"))
