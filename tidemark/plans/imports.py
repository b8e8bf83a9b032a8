"""Registered queries that go through the warehouse's imports, its catalog and the parsers of JSON answers.

Each writes files of the driver's tables in the layout under test to the shared folder, imports them and reads back.
"""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import account, catalog, market, series, sketches, tape
from ..operators.core import changes, latest
from ..operators.scan import numbered
from ..sources import snapshots
from ..sources.files import mounted, sha256
from ..sources.profiles import ProfileStore
from ..sources.shared import shared_folder, stored
from ..sources.warehouse import Warehouse
from . import views as V
from .registry import register

W = V.with_views
SPOT = {"dataset": "trades", "source": "driver", "market": "spot"}


def house_of(spark: SparkSession) -> Warehouse:
    root = mounted(shared_folder(spark))
    return Warehouse(spark, root / "house", [root])


def exported(house: Warehouse, df: DataFrame, name: str, by: str, header: bool = False, form: str = "csv") -> dict[str, Path]:
    """df in the import root, one file for each value of a column that df has besides the layout's; one task each."""
    folder = house.import_roots[0] / name
    df.repartition(by).write.option("header", header).option("maxRecordsPerFile", 0).partitionBy(by).format(form).save(folder.as_uri())
    return {p.parent.name.partition("=")[2]: p for p in sorted(folder.glob(f"{by}=*/part-*.{form if form == 'csv' else '*parquet'}"))}


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def spot_files(house: Warehouse, df: DataFrame, name: str) -> dict[str, Path]:
    """Trades in the headerless layout of seven columns, a file for each symbol."""
    flags = F.initcap(F.col("is_buyer_maker").cast("string")), F.lit("True")
    return exported(house, df.select("trade_id", "price", "qty", "quote_qty", micros("event_time").alias("t"), flags[0].alias("m"), flags[1].alias("b"), "symbol"), name, "symbol")


def spot_house(spark: SparkSession, d: str) -> tuple[Warehouse, dict[str, Path]]:
    """All symbols' spot trades, and their revisions as second files; and the first files."""
    house, df = house_of(spark), V.tape_raw(spark, d).where("market = 'spot'")
    files = [spot_files(house, df.where(f"imported_at = {k}"), f"spot{k}") for k in (1, 2)]
    for each in files:
        for symbol, path in each.items():
            house.import_file(path, "trades", **SPOT, symbol=symbol)
    return house, files[0]


# -- imports -------------------------------------------------------------------------------------------------
@register("k2_ingest_trades", W(["tape"], "SELECT trade_id, price, qty, event_time, is_buyer_maker, true AS is_best_match, 'trades' AS dataset, 'driver' AS source, market, symbol FROM tape WHERE market = 'spot'"), "price qty")
def _(spark, d):
    """Imports of files and of their revisions, read as all rows of the latest revisions."""
    rows = tape.scoped(spot_house(spark, d)[0].select("trades", market="spot"), "trades")
    return rows.select("trade_id", "price", "qty", "event_time", "is_buyer_maker", "is_best_match", "dataset", "source", "market", "symbol")


@register("k2_ingest_aggtrades_zip", W(["agg"], "SELECT agg_trade_id, first_trade_id, last_trade_id, price, qty, event_time, is_buyer_maker, symbol FROM agg WHERE market = 'um'"), "price qty")
def _(spark, d):
    """Aggregate trades with a header, from ZIP files whose checksums are told."""
    house, df = house_of(spark), V.agg_raw(spark, d).where("market = 'um'")
    columns = "agg_trade_id", "price", F.col("qty").alias("quantity"), "first_trade_id", "last_trade_id", micros("event_time").alias("transact_time"), "is_buyer_maker", "symbol"
    for k in (1, 2):
        for symbol, path in exported(house, df.where(f"imported_at = {k}").select(*columns), f"agg{k}", "symbol", True).items():
            packed = house.import_roots[0] / f"agg{k}{symbol}.zip"
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
                z.write(path, "trades.csv")
            house.import_file(packed, "aggtrades", dataset="aggtrades", source="driver", market="um", symbol=symbol, expected_sha256=sha256(packed))
    rows = tape.scoped(house.select("aggtrades", market="um"), "aggtrades")
    return rows.select("agg_trade_id", "first_trade_id", "last_trade_id", "price", "qty", "event_time", "is_buyer_maker", "symbol")


CANDLE = "open high low close volume quote_asset_volume taker_buy_base_asset_volume taker_buy_quote_asset_volume"


@register(
    "k1_ingest_klines",
    W(["tape"], """SELECT symbol, open_time, open, high, low, close, volume, close_time, quote_asset_volume, trade_count, taker_buy_base_asset_volume, taker_buy_quote_asset_volume
 FROM k WHERE market = 'spot'""", {"k": V.candle_sql(3600, "1h")}),
    CANDLE,
)
def _(spark, d):
    house, df = house_of(spark), V.candles_raw(spark, d, 3600, "1h").where("market = 'spot'")
    millis = lambda c: F.floor(micros(c) / 1000)
    columns = "open high low close volume".split(), "quote_asset_volume trade_count taker_buy_base_asset_volume taker_buy_quote_asset_volume".split()
    made = df.select(millis("open_time").alias("a"), *columns[0], millis("close_time").alias("z"), *columns[1], F.lit(0).alias("ignore"), "symbol")
    for symbol, path in exported(house, made, "klines", "symbol").items():
        house.import_file(path, "kline", **SPOT | {"dataset": "klines"}, symbol=symbol, interval="1h")
    return house.select("klines", market="spot", interval="1h").select("symbol", "open_time", *columns[0], "close_time", *columns[1])


VALUES = " ".join(series.METRICS.values)


@register("k3_ingest_metrics", W(["metrics"], f"SELECT symbol, event_time, {', '.join(series.METRICS.values)} FROM metrics"), VALUES)
def _(spark, d):
    """Symbols with other characters than letters and digits in their labels are refused, so they go by their number."""
    house, df = house_of(spark), latest(V.metrics_raw(spark, d), series.METRICS.all_keys)
    at = F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("create_time")
    names = {s[:1]: s for (s,) in df.select("symbol").distinct().collect()}
    made = df.select(at, "symbol", *series.METRICS.values, F.substring("symbol", 1, 1).alias("number"))
    for number, path in exported(house, made, "metrics", "number", True).items():
        house.import_file(path, "metrics", dataset="metrics", source="driver", market="um", symbol=f"P{number}")
    back = F.element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (f"P{k}", v)]), F.col("symbol"))
    return house.select("metrics").select(back.alias("symbol"), "event_time", *series.METRICS.values)


@register("k3_ingest_bookdepth", W(["bookdepth"], "SELECT event_time, percentage, depth, notional FROM bookdepth"), "depth notional")
def _(spark, d):
    """A file for each year."""
    house, df = house_of(spark), latest(V.bookdepth_raw(spark, d), series.BOOKDEPTH.all_keys)
    made = df.select(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "percentage", "depth", "notional", F.year("event_time").alias("of"))
    for path in exported(house, made, "depth", "of", True).values():
        house.import_file(path, "bookdepth", dataset="bookdepth", source="driver", market="um", symbol="DEPTHUSDT")
    return house.select("bookdepth").select("event_time", "percentage", "depth", "notional")


@register("k4_generic_csv", "SELECT CAST(event_id AS INTEGER) AS event_id, event_type, value FROM events")
def _(spark, d):
    """Columns and types as found in the files."""
    house = house_of(spark)
    made = V.table(spark, d, "events").select("event_id", "event_type", "value", F.col("event_type").alias("of"))
    for path in exported(house, made, "events", "of", True).values():
        house.import_file(path, "generic-csv", dataset="events", source="driver")
    return spark.read.parquet(*[r["path"] for r in house.files().collect()]).drop("_warehouse_import_id", "_warehouse_imported_at")


@register("k5_parquet", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def _(spark, d):
    house = house_of(spark)
    made = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", F.col("o_orderstatus").alias("of"))
    for path in exported(house, made, "orders", "of", form="parquet").values():
        house.import_file(path, "parquet", dataset="orders", source="driver")
    return spark.read.parquet(*[r["path"] for r in house.files().collect()]).drop("_warehouse_import_id", "_warehouse_imported_at")


@register(
    "k7_file_statistics",
    W(["tape_raw"], """SELECT symbol, CAST(year(event_time) AS INTEGER) AS year, CAST(month(event_time) AS INTEGER) AS month, count(*) AS row_count, min(event_time) AS min_event_time, max(event_time) AS max_event_time
 FROM tape_raw WHERE market = 'spot' GROUP BY imported_at, symbol, year(event_time), month(event_time)"""),
)
def _(spark, d):
    """One file for each month of an import, with its rows and bounds."""
    return spot_house(spark, d)[0].files().select("symbol", "year", "month", "row_count", "min_event_time", "max_event_time")


@register(
    "q13_status_jobs",
    W(["tape_raw"], """SELECT 'completed' AS status, count(*) AS job_count, CAST(sum(n) AS BIGINT) AS row_count FROM (SELECT count(*) AS n FROM tape_raw WHERE market = 'spot' GROUP BY symbol, imported_at) AS x
 UNION ALL SELECT 'failed', count(DISTINCT symbol), NULL FROM tape_raw WHERE market = 'spot'"""),
)
def _(spark, d):
    """Imports that end; the first file of each symbol is asked for again, which makes no job, and once as a wrong layout."""
    house, firsts = spot_house(spark, d)
    for symbol, path in firsts.items():
        if not house.import_file(path, "trades", **SPOT, symbol=symbol)["duplicate"]:
            raise AssertionError("the same file was imported twice")
        try:
            house.import_file(path, "trades", **SPOT | {"market": "um"}, symbol=symbol)
        except Exception:  # noqa: BLE001  what is under test is the state it leaves
            pass
    return house.jobs().groupBy("status").agg(F.count("*").alias("job_count"), F.sum("row_count").alias("row_count"))


@register(
    "t13_floor_of_sketches",
    W(["tape_raw"], "SELECT symbol, count(*) AS row_count, true AS count_is_near, true AS floor_is_near FROM tape_raw WHERE market = 'spot' GROUP BY symbol"),
)
def _(spark, d):
    """The floor of every symbol's notional from the sketches of its files, and whether it is within their stated error
    of what the rows say: the rows at most as large as it are a share of 0.999, give or take that error."""
    house, _ = spot_house(spark, d)
    told = house.notional_quantiles("trades", [0.999], market="spot")
    rows = V.tape_raw(spark, d).where("market = 'spot'").select("symbol", "trade_id", (F.col("price") * F.col("qty")).alias("notional"))
    met = rows.join(told.drop("market"), "symbol").withColumn("floor", F.col("quantiles")[0])
    at, n = 0.999, F.count("*")
    near = (F.count_if(F.col("notional") <= F.col("floor")) / n >= at - sketches.RANK_ERROR) & (F.count_if(F.col("notional") < F.col("floor")) / n <= at + sketches.RANK_ERROR)
    count = F.abs(F.first("trade_count") / F.countDistinct("trade_id") - 1) <= 0.025
    return met.groupBy("symbol").agg(F.first("row_count").alias("row_count"), count.alias("count_is_near"), near.alias("floor_is_near"))


HALF = "TIMESTAMP '2024-01-15 00:00:00'"


@register(
    "p9_coverage_of_what_is_there",
    W(["tape_raw"], f"""SELECT symbol, count(DISTINCT CAST(event_time AS DATE)) AS covered_day_count, min(CAST(event_time AS DATE)) AS first_day, max(CAST(event_time AS DATE)) AS last_day
 FROM (SELECT symbol, unnest(generate_series(date_trunc('day', min(event_time)), max(event_time), INTERVAL '1 day')) AS event_time FROM tape_raw WHERE market = 'spot' AND imported_at = 1 AND event_time < {HALF} GROUP BY symbol) AS x GROUP BY symbol"""),
)
def _(spark, d):
    """Of two imports a symbol, the files of the second are deleted: their days are no longer covered."""
    house, df = house_of(spark), V.tape_raw(spark, d).where("market = 'spot' AND imported_at = 1")
    for symbol, path in spot_files(house, df.where(f"event_time < {HALF}"), "before").items():
        house.import_file(path, "trades", **SPOT, symbol=symbol)
    later = {house.import_file(path, "trades", **SPOT, symbol=symbol)["import_id"] for symbol, path in spot_files(house, df.where(f"event_time >= {HALF}"), "after").items()}
    for r in house.files().where(F.col("import_id").isin(*later)).collect():
        Path(r["path"]).unlink()
    symbols = sorted(r[0] for r in house.files().select("symbol").distinct().collect())
    told = [(s, *[c[k] for k in ("covered_day_count", "first_day", "last_day")]) for s in symbols for c in [house.coverage("trades", symbol=s)]]
    return spark.createDataFrame(told, "symbol string, covered_day_count bigint, first_day date, last_day date")


@register(
    "p7_null_safe_labels",
    "SELECT n_nationkey, EXISTS (SELECT 1 FROM nation AS b WHERE b.n_nationkey < a.n_nationkey AND CASE WHEN b.n_regionkey % 2 = 1 THEN b.n_regionkey END IS NOT DISTINCT FROM CASE WHEN a.n_regionkey % 2 = 1 THEN a.n_regionkey END) AS duplicate, (SELECT count(*) FROM region) AS row_count FROM nation AS a",
)
def _(spark, d):
    """One file imported for every nation under the market of its region, which even regions lack: imports without a
    market are the same only as others without one."""
    house = house_of(spark)
    (path,) = exported(house, V.table(spark, d, "region").select("r_regionkey", "r_name", F.lit(1).alias("of")), "regions", "of", True).values()
    nations = sorted(tuple(r) for r in V.table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect())
    made = [(k, house.import_file(path, "generic-csv", dataset="regions", source="driver", market=f"m{r}" if r % 2 else None)) for k, r in nations]
    return spark.createDataFrame([(k, m["duplicate"], m["row_count"]) for k, m in made], "n_nationkey bigint, duplicate boolean, row_count bigint")


SEEN = "SELECT nullif(symbol, 'S3USDT') AS symbol, floor(price / 10) AS level, is_buyer_maker FROM tape_raw WHERE trade_id % 7 = 0 AND imported_at = "


@register(
    "r8_revision_changes",
    W(["tape_raw"], """SELECT kind, symbol, level, is_buyer_maker, count(*) AS times FROM (SELECT 'removed' AS kind, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) AS x UNION ALL SELECT 'added', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) AS y
 UNION ALL SELECT 'kept', * FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) AS z) AS w GROUP BY kind, symbol, level, is_buyer_maker""", {"a": SEEN + "1", "b": SEEN + "2"}),
)
def _(spark, d):
    """Republished trades against what they were, by level: one symbol's name is not known, and most rows are repeated."""
    df = V.tape_raw(spark, d).where("trade_id % 7 = 0").withColumns({"symbol": F.nullif("symbol", F.lit("S3USDT")), "level": F.floor(F.col("price") / 10).cast("double")})
    out = changes(df.where("imported_at = 1"), df.where("imported_at = 2"), ["symbol", "level", "is_buyer_maker"])
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("times")) for k in ("removed", "added", "kept")])
    return out.select("symbol", "level", "is_buyer_maker", F.inline(F.filter(kinds, lambda k: k["times"] > 0)))


@register(
    "q11_coverage_levels",
    W(["manifest"], """SELECT CAST(3 - bit_count(GROUPING(dataset, market, symbol)) AS INTEGER) AS depth, dataset, market, symbol, count(*) FILTER (WHERE nth = 1) AS file_count, CAST(sum(row_count) FILTER (WHERE nth = 1) AS BIGINT) AS row_count, CAST(sum(file_size_bytes) FILTER (WHERE nth = 1) AS BIGINT) AS byte_count, count(DISTINCT day) AS day_count FROM days GROUP BY ROLLUP (dataset, market, symbol)""",
      {"days": "SELECT dataset, market, symbol, row_count, file_size_bytes, unnest(generate_series(date_trunc('day', min_event_time), max_event_time, INTERVAL '1 day')) AS day, unnest(range(1, 2 + datediff('day', min_event_time, max_event_time))) AS nth FROM manifest"}),
)
def _(spark, d):
    return catalog.coverage_levels(V.manifest(spark, d))


# -- limits that bite, and orders ----------------------------------------------------------------------------
MANY = "'S' || CAST(user_id % 97 AS VARCHAR) || CASE WHEN user_id % 97 < 80 THEN 'USDT' ELSE 'EUR' END"


@register("d6_top30_of_many", f"SELECT symbol, quote_volume FROM (SELECT {MANY} AS symbol, sum(value) AS quote_volume FROM events GROUP BY user_id % 97) AS x WHERE symbol LIKE '%USDT' ORDER BY quote_volume DESC, symbol LIMIT 30", "quote_volume")
def _(spark, d):
    n = F.col("user_id") % 97
    symbol = F.concat(F.lit("S"), n, F.when(n < 80, "USDT").otherwise("EUR"))
    return market.overview(V.table(spark, d, "events").groupBy(symbol.alias("symbol")).agg(F.sum("value").alias("quote_volume")))


@register("q12_files_limited", W(["manifest"], "SELECT path FROM manifest ORDER BY created_at DESC, path LIMIT 12"))
def _(spark, d):
    return catalog.list_files(V.manifest(spark, d), 12).select("path")


LEVELS = V.level_sql("tape", 86400)


@register(
    "d4_footprint_order",
    W(["tape"], f"SELECT market, symbol, bucket_start, price, row_number() OVER (ORDER BY market, symbol, bucket_start, volume DESC, price) AS place FROM ({LEVELS}) AS x"),
    "price",
)
def _(spark, d):
    """The place of each level in the whole footprint, by ranges of it."""
    df = tape.footprint(V.tape_raw(spark, d), "trades", 86400, "1900-01-01T00:00:00Z", "2200-01-01T00:00:00Z")
    order = [F.asc_nulls_last("market"), F.asc_nulls_last("symbol"), *tape.footprint_order()]
    levels = numbered(stored(df.select("market", "symbol", "bucket_start", "price", "volume")), [], order, "nth")
    return levels.select("market", "symbol", "bucket_start", "price", (F.col("nth") + 1).alias("place"))


# -- answers in JSON -----------------------------------------------------------------------------------------
def bodies(df: DataFrame, *names: str, **columns) -> DataFrame:
    """A JSON object a row, with null members left out."""
    return df.select(F.to_json(F.struct(*names, *[c.alias(k) for k, c in columns.items()])).alias("body"))


def text(c: str):
    return F.col(c).cast("string")


@register(
    "s9_klines",
    W(["tape"], """SELECT epoch_us(open_time) // 1000 AS open_time, open, high, low, close, volume, epoch_us(close_time) // 1000 AS close_time, quote_asset_volume AS quote_volume, trade_count FROM k""", {"k": V.candle_sql(86400, "1d")}),
    "open high low close volume quote_volume",
)
def _(spark, d):
    df = V.candles_raw(spark, d, 86400, "1d")
    millis = lambda c: F.floor(micros(c) / 1000).cast("string")
    cells = F.array(millis("open_time"), *map(text, ("open", "high", "low", "close", "volume")), millis("close_time"), text("quote_asset_volume"), text("trade_count"), F.lit("0"))
    # An answer holds a month of a symbol.
    return snapshots.klines(df.groupBy("market", "symbol", F.trunc("open_time", "month")).agg(F.to_json(F.collect_list(cells)).alias("body")).select("body"))


@register("s10_tickers", W(["tickers"], "SELECT symbol, last_price, price_change_percent, quote_volume, high_price, low_price FROM tickers"), "last_price price_change_percent quote_volume high_price low_price")
def _(spark, d):
    names = {"lastPrice": "last_price", "priceChangePercent": "price_change_percent", "quoteVolume": "quote_volume", "highPrice": "high_price", "lowPrice": "low_price"}
    return snapshots.tickers(bodies(V.tickers(spark, d), "symbol", **{k: text(v) for k, v in names.items()}))


@register("s11_order_books", W(["levels"], "SELECT symbol, side, price, qty FROM levels"), "price qty")
def _(spark, d):
    # An answer holds some levels of a symbol's book, at most 200.
    some = lambda side: F.collect_list(F.when(F.col("side") == side, F.array(text("price"), text("qty"))))
    books = V.levels(spark, d).groupBy("symbol", F.floor(F.col("p_partkey") / 200)).agg(some("bid").alias("bids"), some("ask").alias("asks"))
    parsed = snapshots.order_books(bodies(books, "symbol", "bids", "asks", lastUpdateId=F.lit(1)))
    side = lambda name, c: parsed.select("symbol", F.lit(name).alias("side"), F.explode(c).alias("x")).select("symbol", "side", "x.price", "x.qty")
    return side("bid", "bids").unionByName(side("ask", "asks"))


@register("s12_exchange_info", "SELECT 'S' || CAST(c_custkey AS VARCHAR) AS symbol, c_mktsegment AS status, c_name AS base_asset, 'USDT' AS quote_asset, 'LIMIT,MARKET' AS order_types, CAST(c_nationkey AS VARCHAR) AS tick FROM customer")
def _(spark, d):
    c = V.table(spark, d, "customer")
    one = F.struct(
        F.concat(F.lit("S"), "c_custkey").alias("symbol"),
        F.col("c_mktsegment").alias("status"),
        F.col("c_name").alias("baseAsset"),
        F.lit("USDT").alias("quoteAsset"),
        F.array(F.lit("LIMIT"), F.lit("MARKET")).alias("orderTypes"),
        F.array(F.struct(F.lit("PRICE").alias("filterType"), F.col("c_nationkey").alias("tick"), F.array(F.lit(1)).alias("nested"))).alias("filters"),
    )
    out = snapshots.exchange_info(bodies(c, symbols=F.array(one)))
    tick = F.when(F.array_size(F.map_keys(F.get("filters", F.lit(0)))) == 2, F.get("filters", F.lit(0))["tick"])
    return out.select("symbol", "status", "base_asset", "quote_asset", F.array_join("order_types", ",").alias("order_types"), tick.alias("tick"))


@register("s13_premium_index", W(["premium"], "SELECT symbol, mark_price, index_price, mark_price AS estimated_settle_price, last_funding_rate, CAST(5 AS BIGINT) AS next_funding_time, CAST(4 AS BIGINT) AS time FROM premium"), "mark_price index_price estimated_settle_price last_funding_rate", 8)
def _(spark, d):
    made = {"markPrice": "mark_price", "indexPrice": "index_price", "estimatedSettlePrice": "mark_price", "lastFundingRate": "last_funding_rate"}
    return snapshots.premium_index(bodies(V.premium(spark, d), "symbol", **{k: text(v) for k, v in made.items()}, nextFundingTime=F.lit(5), time=F.lit(4)))


@register("s14_open_interest", "SELECT 'S' || CAST(event_id AS VARCHAR) AS symbol, value AS open_interest, epoch_us(ts) // 1000 AS time FROM events", "open_interest")
def _(spark, d):
    e = V.table(spark, d, "events")
    return snapshots.open_interest(bodies(e, symbol=F.concat(F.lit("S"), "event_id"), openInterest=text("value"), time=F.floor(micros("ts") / 1000)))


@register("s15_funding_rates", "SELECT 'S' || CAST(event_id AS VARCHAR) AS symbol, value AS funding_rate, epoch_us(ts) // 1000 AS funding_time, CASE WHEN event_id % 2 = 0 THEN value + 1 END AS mark_price FROM events", "funding_rate mark_price")
def _(spark, d):
    """Every other answer has an empty mark price."""
    mark = F.when(F.col("event_id") % 2 == 0, (F.col("value") + 1).cast("string")).otherwise("")
    one = F.struct(F.concat(F.lit("S"), "event_id").alias("symbol"), text("value").alias("fundingRate"), F.floor(micros("ts") / 1000).alias("fundingTime"), mark.alias("markPrice"))
    return snapshots.funding_rates(V.table(spark, d, "events").select(F.to_json(F.array(one)).alias("body")))


# -- accounts ------------------------------------------------------------------------------------------------
@register("ac5_profiles", """SELECT 'p' || CAST(n_nationkey AS VARCHAR) AS "profileId", CASE WHEN n_nationkey % 2 = 0 THEN 'spot' ELSE 'futures' END AS product, 'testnet' AS environment, n_nationkey < 2 AS "isDefault" FROM nation""")
def _(spark, d):
    """A store of profiles and what it shows of them: nothing secret."""
    path = mounted(shared_folder(spark)) / "profiles.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    keys = sorted(r[0] for r in V.table(spark, d, "nation").select("n_nationkey").collect())
    made = [{"id": f"p{k}", "product": "futures" if k % 2 else "spot", "environment": "testnet", "api_key": f"secret{k}", "private_key_path": "/keys/k.pem", "default": k < 2} for k in keys]
    path.write_text(json.dumps(made))
    return account.profiles(spark.createDataFrame(ProfileStore(path).status()))


FLAWS = ("amount", "id", "missing", "none")


@register("ac6_refused_records", "SELECT o_custkey % 8 AS batch, count(*) AS order_count, o_custkey % 4 <> 3 AND count(*) FILTER (WHERE o_orderkey % 97 = 0) > 0 AS refused FROM orders GROUP BY o_custkey % 8, o_custkey % 4")
def _(spark, d):
    """Open orders in eight batches. In some batches a few orders have a flaw: the batch is refused as a whole."""
    orders = V.account_orders(spark, d).withColumn("batch", F.pmod("time", F.lit(8)))
    flaw = F.when((F.col("orderId") - 9007199254740993) % 97 == 0, F.element_at(F.array(*map(F.lit, FLAWS)), (F.col("batch") % 4 + 1).cast("int"))).otherwise("none")
    orders = orders.withColumn("flaw", flaw).withColumns(
        {
            "price": F.when(F.col("flaw") == "amount", "1,5").otherwise(F.col("price")),
            "orderId": F.when(F.col("flaw") == "id", "12x").otherwise(F.col("orderId").cast("string")),
            "side": F.when(F.col("flaw") != "missing", F.col("side")),
        }
    )

    def refused(df: DataFrame) -> bool:
        try:
            account.open_orders(df).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001  Spark wraps what the check raises
            return "is not a" in str(e) or "is missing" in str(e)
        return False

    counts = sorted(tuple(r) for r in orders.groupBy("batch").count().collect())
    return spark.createDataFrame([(k, n, refused(orders.where(F.col("batch") == k).drop("batch", "flaw"))) for k, n in counts], "batch bigint, order_count bigint, refused boolean")
