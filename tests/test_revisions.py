"""Buckets of a stream with republished trades against those of the batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import tape
from tidemark.plans import views as V
from tidemark.streaming.revisions import RevisedBuckets, latest_revisions

D = "/root/testdata/sf0.001"
COLUMNS = ["market", "symbol", "bucket_start", "trade_count", "open", "close", "high", "low", "volume", "large_trade_count"]


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*COLUMNS).collect())


def moved(spark):
    """Republished trades; every second of them also gets another time, and some another symbol."""
    df = V.tape_raw(spark, D)
    again = F.col("imported_at") == 2
    time = F.when(again & (F.col("trade_id") % 2 == 0), F.col("event_time") + F.expr("interval 3 days")).otherwise(F.col("event_time"))
    symbol = F.when(again & (F.col("trade_id") % 5 == 0), "MOVEDUSDT").otherwise(F.col("symbol"))
    return df.withColumns({"event_time": time, "symbol": symbol})


@pytest.mark.parametrize("first", [1, 2])
def test_the_stream_gives_the_batch_after_republications_and_a_restart(spark, tmp_path, first):
    """first = 2: the republication comes before the trade it replaces."""
    src, source, out = moved(spark), str(tmp_path / "tape"), RevisedBuckets((tmp_path / "out").as_uri(), "trades", 86400, floor=3000)

    def run():
        q = out.start(spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 2).parquet(source), str(tmp_path / "cp"), availableNow=True)
        q.awaitTermination()
        assert q.exception() is None

    src.where(f"imported_at = {first}").repartition(3).write.parquet(source)
    run()
    before = {r[:3]: r for r in rows(out.buckets(spark))}
    assert list(before.values()) == rows(tape.tape_buckets(src.where(f"imported_at = {first}"), "trades", 86400, min_notional=3000))
    src.where(f"imported_at <> {first}").repartition(2).write.mode("append").parquet(source)
    run()
    after = rows(out.buckets(spark))
    assert after == rows(tape.tape_buckets(src, "trades", 86400, min_notional=3000))
    told = out.corrections(spark)
    if first == 1:  # closed buckets were corrected
        assert any(before.get(r[:3], r) != r for r in after) and told.where("revision > 1 and batch >= 2").count() > 0
    n = told.count()
    run()  # nothing new: nothing told
    assert out.corrections(spark).count() == n and rows(out.buckets(spark)) == after


def test_a_batch_that_runs_again_tells_the_same(spark, tmp_path):
    src, out = moved(spark), RevisedBuckets((tmp_path / "out").as_uri(), "trades", 3600)
    changed = latest_revisions(src.where("imported_at = 1"), "trades", 3600, out.by)
    more = latest_revisions(src, "trades", 3600, out.by)
    out.write(changed, 0)
    out.write(more.limit(0), 1)
    for _ in range(2):
        out.write(more, 2)
        assert rows(out.buckets(spark).withColumn("large_trade_count", F.lit(0))) == rows(tape.tape_buckets(src, "trades", 3600).withColumn("large_trade_count", F.lit(0)))
    assert out.corrections(spark).groupBy(*out.by, "bucket_start", "batch").count().where("count > 1").isEmpty()


def test_a_bucket_that_all_trades_left(spark, tmp_path):
    out = RevisedBuckets((tmp_path / "out").as_uri(), "trades", 60)
    one = moved(spark).where("trade_id = 14").persist()
    out.write(latest_revisions(one.where("imported_at = 1"), "trades", 60, out.by), 0)
    out.write(latest_revisions(one, "trades", 60, out.by), 1)
    assert out.buckets(spark).count() == 1 and sorted(r.trade_count for r in out.corrections(spark).collect()) == [0, 1, 1]


def test_old_trades_are_forgotten(spark, tmp_path):
    """With keep, the state does not grow with the history, and a revision in time still replaces."""
    src = V.tape_raw(spark, D)
    out, source = RevisedBuckets((tmp_path / "out").as_uri(), "trades", 86400, keep="1 day"), str(tmp_path / "tape")
    ordered = src.orderBy(F.to_date("event_time"), "imported_at").coalesce(1)
    ordered.write.option("maxRecordsPerFile", 100).parquet(source)
    q = out.start(spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination()
    assert rows(out.buckets(spark).withColumn("large_trade_count", F.lit(0))) == rows(tape.tape_buckets(src, "trades", 86400).withColumn("large_trade_count", F.lit(0)))
    kept = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert kept and kept[-1] < src.select("market", "trade_id").distinct().count() / 2
