"""Every query with SQL against DuckDB on the smallest tables, a plan or two, and the stream against the batch."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import tape
from tidemark.plans import catalogue
from tidemark.plans import views as V
from tidemark.streaming.tape_stream import bucket_stream, read_tape

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def normal(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_against_sql(spark, con, name):
    df = catalogue.queries()[name](spark, D)
    names = sorted(df.columns)
    ours = sorted(tuple(normal(r[c]) for c in names) for r in df.collect())
    cur = con.execute(catalogue.oracle_sql()[name])
    theirs = [c[0] for c in cur.description]
    assert sorted(theirs) == names
    at = [theirs.index(c) for c in names]
    assert ours == sorted(tuple(normal(r[i]) for i in at) for r in cur.fetchall())


def test_ranking_prunes_before_the_shuffle_and_bounds_reach_the_scan(spark):
    df = tape.tape_rows(V.tape_raw(spark, D), "trades", start=catalogue.START)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_the_stream_gives_the_batch(spark, tmp_path):
    src = V.tape_raw(spark, D).where("imported_at = 1")
    # A last trade far ahead closes all windows before it.
    last = src.limit(1).withColumns({"trade_id": F.lit(-1).cast("bigint"), "event_time": F.lit(dt.datetime(2030, 1, 1)).cast("timestamp_ntz")})
    src.write.parquet(str(tmp_path / "tape"))
    last.write.mode("append").parquet(str(tmp_path / "tape"))
    stream = bucket_stream(read_tape(spark, str(tmp_path / "tape"), src.schema), "trades", 86400)
    q = stream.writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["market"], r["symbol"], r["bucket_start"]): (r["trade_count"], r["open"], round(r["volume"], 6)) for r in spark.table("buckets").collect()}
    want = {(r["market"], r["symbol"], r["bucket_start"]): (r["trade_count"], r["open"], round(r["volume"], 6)) for r in tape.tape_buckets(src, "trades", 86400).collect()}
    assert got == want
