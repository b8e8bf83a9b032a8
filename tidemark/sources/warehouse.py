"""The warehouse: typed imports into partitioned Parquet, a catalog of files and jobs, and queries over a selection.

Data files are immutable and named by import. The catalog is a log of commits; a job's latest row is its state, and
the commit that completes a job brings its files, so nothing else is ever read. One writer at a time within a
process, and any number of processes: of two that import the same file at once one gives the other's import. The root
is a folder that the driver and all executors have under the same path; whatever executors are told to read lies in it.
"""

from __future__ import annotations

import json
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import validate as V
from ..operators import candles as candle_ops
from ..operators import catalog, series, sketches, tape
from ..operators.core import capped
from .commits import CommitLog
from .files import DEFAULT_BYTES, MOST_BYTES, audit_url, download, inside_any, mounted, sha256, unzip_csv, verify
from .schemas import FILES, JOBS, PROFILES, layouts, table_schema

MESSAGE_CHARS = 2000
#: Bytes of text that one task reads and writes.
FILE_BYTES = 64 << 20
IDENTITY = ("checksum", "dataset", "source", "profile", "market", "symbol", "interval", "options")


class ImportedMeanwhile(Exception):
    """Another process has completed the same import."""


class Warehouse:
    def __init__(self, spark: SparkSession, root: str | Path, import_roots: Iterable[str | Path] = (), max_bytes: int = DEFAULT_BYTES):
        """Files are imported from import_roots alone: without any, by URL only. root is a path or a file: URI."""
        V.need(0 < max_bytes <= MOST_BYTES, "max_bytes: out of range")
        self.spark, self.max_bytes, self.lock = spark, max_bytes, threading.Lock()
        self.root, self.import_roots = mounted(root), [mounted(r) for r in import_roots]
        self.log = CommitLog(spark, self.root / "catalog", {"jobs": JOBS, "files": FILES}, self._newest)
        self.arriving = self.root / "arriving"
        self.arriving.mkdir(parents=True, exist_ok=True)

    # -- catalog ---------------------------------------------------------------------------------------------
    @staticmethod
    def _newest(name: str, rows: DataFrame) -> DataFrame:
        """Of a job the last row; of files all."""
        if name == "files":
            return rows.sortWithinPartitions("dataset", "market", "symbol", "min_event_time")
        return rows.withColumn("k", F.row_number().over(Window.partitionBy("import_id").orderBy(F.desc("commit")))).where("k = 1").drop("k")

    def jobs(self) -> DataFrame:
        return self._newest("jobs", self.log.read("jobs")).drop("commit")

    def files(self) -> DataFrame:
        return self.log.read("files").drop("commit")

    def _job(self, import_id: str, status: str, info: dict, message: str | None = None, rows: int | None = None) -> tuple[str, dict]:
        return "jobs", {"import_id": import_id, "status": status, **{k: info[k] for k in IDENTITY}, "message": message and message[:MESSAGE_CHARS], "row_count": rows, "created_at": datetime.now(UTC).isoformat()}

    # -- imports ---------------------------------------------------------------------------------------------
    def import_url(self, url: str, profile: str, **labels) -> dict:
        with tempfile.TemporaryDirectory(dir=self.arriving) as folder:
            path = download(url, folder, self.max_bytes)
            return self._import(path, profile, labels) | {"url": audit_url(url)}

    def import_file(self, path: str | Path, profile: str, **labels) -> dict:
        """dataset, source, market, symbol, interval, has_header, zip_entry and expected_sha256 say what the file is.
        It has to lie in an import root, links resolved. The same file under the same labels gives its earlier import
        again, with duplicate = True."""
        return self._import(inside_any(self.import_roots, mounted(path)), profile, labels)

    def check(self, profile: str, dataset: str, source: str, market=None, symbol=None, interval=None, has_header=None, zip_entry=None, expected_sha256=None) -> dict:
        V.need(profile in PROFILES, f"profile: one of {', '.join(PROFILES)}")
        info = {"profile": profile, "dataset": V.label(dataset, "dataset"), "source": V.label(source, "source")}
        info["market"] = market and V.label(market, "market")
        info["symbol"] = symbol and V.label(symbol.upper(), "symbol")
        info["interval"] = interval and V.label(interval, "interval")
        if profile == "kline":
            V.need(bool(symbol and interval), "kline: symbol and interval are needed")
        if expected := PROFILES[profile]:
            V.need(dataset == expected, f"{profile}: the dataset is {expected}")
            V.need(bool(market and symbol), f"{profile}: market and symbol are needed")
            V.need((expected, market) in layouts(), f"{profile}: not for market {market}")
            V.need(interval is None, f"{profile}: no interval")
            V.need(has_header is None, f"{profile}: the layout says whether there is a header")
        info["options"] = json.dumps({"has_header": has_header, "zip_entry": zip_entry}, sort_keys=True)
        return info

    def _import(self, path: Path, profile: str, labels: dict) -> dict:
        info = self.check(profile, **labels)
        V.need(path.suffix.lower() in ((".parquet",) if profile == "parquet" else (".csv", ".zip")), f"{profile}: not for {path.suffix} files")
        V.need(path.stat().st_size <= self.max_bytes, "the file is too large")
        info["checksum"] = sha256(path)
        verify(info["checksum"], labels.get("expected_sha256"))
        with self.lock:
            seen = self.log.version()
            if old := self._same(info):
                return old
            import_id = str(uuid.uuid4())
            parts = [f"{k}={info[k]}" for k in ("dataset", "source", "market", "symbol", "interval") if info[k]]
            out = self.root.joinpath("data", *parts, f"import={import_id}")
            self.log.append([self._job(import_id, "running", info)])
            try:
                with tempfile.TemporaryDirectory(dir=self.arriving) as folder:
                    if path.suffix.lower() == ".zip":
                        path = unzip_csv(path, folder, labels.get("zip_entry"), self.max_bytes)
                    time = self._write(path, profile, info, labels.get("has_header"), import_id, out)
                files = self._described(import_id, info, out, time)
                rows = sum(f["row_count"] for f in files)
                V.need(rows > 0, "the file has no rows")
                # What another process has completed meanwhile is looked for with each number that is tried.
                done = [("files", f) for f in files] + [self._job(import_id, "completed", info, rows=rows)]
                self.log.append(done, seen, lambda since: self._refuse(since, info))
            except Exception as e:
                for folder in (out, self._sketched(import_id)):
                    shutil.rmtree(folder, ignore_errors=True)
                self.log.append([self._job(import_id, "failed", info, str(e))])
                if isinstance(e, ImportedMeanwhile) and (old := self._same(info)):
                    return old
                raise
            return {"import_id": import_id, "duplicate": False, "row_count": rows}

    def _same(self, info: dict) -> dict | None:
        """The completed import of the same file under the same labels whose files are all there."""
        for old in self.log.find("jobs", status="completed", **{k: info[k] for k in IDENTITY}):
            held = self.log.find("files", import_id=old["import_id"])
            if held and all(Path(r["path"]).exists() for r in held):
                return {"import_id": old["import_id"], "duplicate": True, "row_count": old["row_count"]}
        return None

    @staticmethod
    def _refuse(since: list[dict], info: dict) -> None:
        for row in since:
            if row["table"] == "jobs" and row["status"] == "completed" and all(row[k] == info[k] for k in IDENTITY):
                raise ImportedMeanwhile(f"imported at the same time as {row['import_id']}")

    def _write(self, path: Path, profile: str, info: dict, has_header: bool | None, import_id: str, out: Path) -> str | None:
        now = F.lit(datetime.now(UTC))
        if profile in ("generic-csv", "parquet"):
            header = True if has_header is None else has_header
            df = self.spark.read.parquet(str(path)) if profile == "parquet" else self.spark.read.option("header", header).option("inferSchema", True).option("mode", "FAILFAST").csv(str(path))
            df.withColumns({"_warehouse_import_id": F.lit(import_id), "_warehouse_imported_at": now}).write.option("compression", "zstd").parquet(str(out))
            return None
        known = layouts()
        layout = known[("klines", None)] if profile == "kline" else known[(info["dataset"], info["market"])]
        reader = self.spark.read.schema(layout.columns).option("mode", "FAILFAST").option("header", layout.header)
        df = reader.option("enforceSchema", not layout.header).csv(str(path)).select(*layout.made)
        labels = ["dataset", "source", "market", "symbol"] + ["interval"] * (profile == "kline")
        df = df.withColumns({k: F.lit(info[k]).cast("string") for k in labels} | {"import_id": F.lit(import_id), "imported_at": now})
        df = df.withColumns({"year": F.year(layout.time), "month": F.month(layout.time)})
        # A month's rows are in as many files as the import has of these, and not one for each core.
        df = df.coalesce(max(1, -(-path.stat().st_size // FILE_BYTES)))
        df.sortWithinPartitions(layout.time).write.partitionBy("year", "month").option("compression", "zstd").parquet(str(out))
        return layout.time

    def _sketched(self, import_id: str) -> Path:
        return self.root / "catalog" / "sketches" / f"import={import_id}"

    def _described(self, import_id: str, info: dict, out: Path, time: str | None) -> list[dict]:
        """An import's files: where and how large they are, their rows and bounds."""
        df = self.spark.read.parquet(str(out))
        empty = F.lit(None).cast("timestamp_ntz")
        low, high = (F.min(time), F.max(time)) if time else (F.min(empty), F.max(empty))
        per = df.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size_bytes"))
        more = sketches.of_file(info["dataset"]) if info["profile"] in V.TAPE_DATASETS else []
        stats = per.agg(F.count("*").alias("row_count"), low.alias("min_event_time"), high.alias("max_event_time"), *more)
        if more:
            # The sketches stay where they are; only what the catalog says of a file comes to the driver.
            place = str(self._sketched(import_id))
            stats.write.parquet(place)
            stats = self.spark.read.schema(stats.schema).parquet(place).drop("notionals", "ids")
        part = lambda name: F.regexp_extract("path", f"/{name}=(\\d+)/", 1)
        made = {"path": F.regexp_replace(F.url_decode("path"), "^file:/*", "/")} | {k: F.when(part(k) != "", part(k).try_cast("int")) for k in ("year", "month")}
        labels = {k: info[k] for k in ("dataset", "source", "profile", "market", "symbol", "interval")}
        now = datetime.now(UTC).isoformat()
        rows = [r.asDict() | labels | {"import_id": import_id, "created_at": now} for r in stats.withColumns(made).collect()]
        return [{k: v.isoformat() if isinstance(v, datetime) else v for k, v in r.items()} for r in rows]

    # -- selections ------------------------------------------------------------------------------------------
    def _there(self, path: str) -> bool:
        return Path(path).exists() and Path(path).resolve().is_relative_to((self.root / "data").resolve())

    def existing_files(self) -> DataFrame:
        """The catalog's files that are still there, and within the data folder."""
        files = self.files()
        gone = [(r["path"],) for r in files.select("path").collect() if not self._there(r["path"])]
        return files.join(self.spark.createDataFrame(gone, "path string"), "path", "left_anti") if gone else files

    def select(self, dataset: str, start=None, end=None, **labels) -> DataFrame:
        """Data of the selection's files that may touch the window and are still there: an empty frame of the dataset's
        columns if there are none. The columns of known datasets are not looked for in the files."""
        found = catalog.overlapping(catalog.selected(self.files(), dataset=V.label(dataset, "dataset"), **labels), start, end)
        paths = [p for (p,) in found.select("path").orderBy("path").collect() if self._there(p)]
        schema = table_schema(self.spark, dataset, labels.get("interval"))
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def query_candles(self, dataset: str, symbol: str, interval: str, source=None, market=None, start=None, end=None, limit: int = 500) -> DataFrame:
        V.limit(limit, V.MAX_ROWS)
        df = self.select(dataset, source=source, market=market, symbol=symbol.upper(), interval=V.interval(interval))
        return candle_ops.candles(df, start, end, limit)

    def query_trades(self, dataset: str, market: str, symbol: str, source=None, limit: int = 500, bucket_seconds: int | None = None, by_price: bool = False, start=None, end=None, **scope) -> DataFrame:
        """Rows, or time buckets, or price levels of time buckets: see operators.tape."""
        V.tape_selection(dataset, market)
        V.limit(limit, V.MAX_ROWS)
        mode = "prices" if by_price else "buckets" if bucket_seconds else "rows"
        V.tape_filters(dataset, mode, start=start, end=end, bucket_seconds=bucket_seconds, **scope)
        df = self.select(dataset, start, end, source=source, market=market, symbol=symbol.upper())
        if mode == "rows":
            return tape.tape_rows(df, dataset, limit, start=start, end=end, **scope)
        if mode == "buckets":
            return capped(tape.tape_buckets(df, dataset, bucket_seconds, by=(), start=start, end=end, **scope), limit, [F.asc("bucket_start")], "buckets")
        return capped(tape.footprint(df, dataset, bucket_seconds, start, end, by=(), **scope), limit, tape.footprint_order(), "price levels")

    def query_series(self, dataset: str, symbol: str, market: str = "um", source=None, limit: int = 500, bucket_seconds: int | None = None, **scope) -> DataFrame:
        V.series_filters(dataset, scope.get("percentage"), bucket_seconds)
        V.need(market == "um", "market: series are for um")
        V.need(bucket_seconds is None or bucket_seconds <= V.MAX_BUCKET_SECONDS, f"bucket_seconds: at most {V.MAX_BUCKET_SECONDS}")
        V.limit(limit, V.MAX_ROWS)
        spec = series.METRICS if dataset == "metrics" else series.BOOKDEPTH
        df = self.select(dataset, scope.get("start"), scope.get("end"), source=source, market=market, symbol=symbol.upper())
        if bucket_seconds is None:
            return series.series_rows(df, spec, limit, **scope)
        order = [F.asc("bucket_start"), *map(F.asc, spec.keys)]
        return capped(series.series_buckets(df, spec, bucket_seconds, groups=(), **scope), limit, order, "buckets")

    def data_range(self, dataset: str, symbol: str, market=None, interval=None, source=None, start=None, end=None) -> dict:
        """row_count, min_time and max_time of the latest revisions. A window selects files, not rows."""
        labels = {"source": source, "symbol": symbol.upper(), "market": market, "interval": interval}
        if dataset in V.TAPE_DATASETS:
            V.tape_selection(dataset, market)
            V.need(interval is None, "interval: tapes have none")
            make = lambda df: tape.tape_range(df, dataset)
        elif dataset in V.SERIES_DATASETS:
            labels["market"] = market or "um"
            V.need(labels["market"] == "um" and interval is None, "series: market um and no interval")
            make = lambda df: series.series_range(df, series.METRICS if dataset == "metrics" else series.BOOKDEPTH)
        else:
            V.need(interval is not None and start is None and end is None, "candles: an interval and no window")
            make = candle_ops.candle_range
        df = self.select(dataset, start, end, **labels)
        return make(df).first().asDict()

    def notional_quantiles(self, dataset: str, shares: Iterable[float], start=None, end=None, **labels) -> DataFrame:
        """Per market and symbol, about: quantiles of the notional of all rows imported, revisions too, and how many trades
        they are. From sketches that imports keep; no data file is read. A window selects files, not rows."""
        V.need(dataset in V.TAPE_DATASETS, f"dataset: one of {', '.join(V.TAPE_DATASETS)}")
        shares = [V.number(s, "shares", minimum=0) for s in shares]
        V.need(bool(shares) and max(shares) <= 1, "shares: from 0 to 1")
        found = catalog.overlapping(catalog.selected(self.files(), dataset=dataset, **labels), start, end)
        imports = sorted(r[0] for r in found.select("import_id").distinct().collect())
        schema = "path string, row_count bigint, notionals binary, ids binary"
        paths = [str(self._sketched(i)) for i in imports]
        held = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        held = held.withColumn("path", F.regexp_replace(F.url_decode("path"), "^file:/*", "/"))
        return sketches.notional_quantiles(held.join(found.select("path", "market", "symbol"), "path"), shares)

    def coverage(self, dataset: str, start=None, end=None, **labels) -> dict:
        """Days that files which are still there cover, and those missing."""
        found = catalog.selected(self.existing_files(), dataset=dataset, **labels)
        return catalog.coverage(found, start, end).first().asDict()

    def list_datasets(self) -> DataFrame:
        return catalog.list_datasets(self.files())

    def list_files(self, limit: int = 100, **labels: str | None) -> DataFrame:
        return catalog.list_files(self.files(), limit, **labels)

    def status(self) -> dict:
        """Jobs by state, totals of the files, and where and how large imports may be."""
        jobs = {r["status"]: r["job_count"] for r in catalog.job_counts(self.jobs()).collect()}
        places = {"root": str(self.root), "data": str(self.root / "data"), "catalog": str(self.root / "catalog"), "import_roots": [str(r) for r in self.import_roots], "max_import_bytes": self.max_bytes}
        return {"jobs": jobs, **places, **catalog.totals(self.files()).first().asDict()}
