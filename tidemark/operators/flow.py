"""Order-flow readings over bucket, footprint and series results. They describe the past and name candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import between_values, ratio, rescaled_ratio
from ..sources.shared import stored
from .scan import beside, sessions
from .tape import scoped

#: Quote units from which a trade of a major market counts as large, and a span that is unusual there.
LARGE_NOTIONAL, LONG_SPAN = 100_000, 20
#: Of the sketch that brackets a quantile: ranks are known within the inverse of it.
ACCURACY = 10_000


def rescaled(metrics: DataFrame, column: str) -> DataFrame:
    return metrics.withColumn("signed_share", rescaled_ratio(F.col(column)))


def period_imbalance(buckets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The volume-weighted and the plain mean imbalance, which answer two questions."""
    return buckets.groupBy(*by).agg(
        ratio(F.sum("taker_delta"), F.sum(F.col("taker_buy_volume") + F.col("taker_sell_volume"))).alias("weighted_imbalance"),
        F.avg("taker_imbalance").alias("unweighted_imbalance"),
        F.count("*").alias("bucket_count"),
    )


def _sign(c: Column) -> Column:
    return F.signum(c).cast("int")


def divergence(buckets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Changes of close and of the running delta from the bucket before; diverging if their signs are opposite."""
    w = Window.partitionBy(*by).orderBy("bucket_start")
    price, flow = F.col("close") - F.lag("close").over(w), F.col("cvd") - F.lag("cvd").over(w)
    out = buckets.select(*by, "bucket_start", price.alias("price_change"), flow.alias("cvd_change"))
    return out.withColumn("diverging", F.coalesce(_sign(F.col("price_change")) * _sign(F.col("cvd_change")) < 0, F.lit(False)))


def block_ratio(buckets: DataFrame, by: Sequence[str]) -> DataFrame:
    return buckets.select(*by, "bucket_start", ratio(F.coalesce("large_trade_notional", F.lit(0.0)), F.col("quote_volume")).alias("block_ratio"))


def sweeps(tape: DataFrame, floor: float = LARGE_NOTIONAL, long_span: int = LONG_SPAN) -> DataFrame:
    """Large aggregate trades: those that took many resting orders, and single heavy fills."""
    out = scoped(tape, "aggtrades", min_notional=floor)
    span = F.col("last_trade_id") - F.col("first_trade_id") + 1
    return out.select("market", "symbol", "agg_trade_id", "event_time", (F.col("price") * F.col("qty")).alias("notional"), span.alias("span"), F.when(span > long_span, "sweep").otherwise("heavy_fill").alias("kind"))


def sweep_sessions(tape: DataFrame, gap_seconds: int, floor: float = LARGE_NOTIONAL, long_span: int = LONG_SPAN, by: Sequence[str] = ("market", "symbol")) -> DataFrame:
    """Large aggregate trades that follow one another within gap_seconds, as one: from when to when, how many, how
    many of them sweeps, and their notional."""
    out = sessions(sweeps(tape, floor, long_span), by, "event_time", F.make_dt_interval(secs=F.lit(gap_seconds)))
    return out.groupBy(*by, "session").agg(
        F.min("event_time").alias("first_event_time"), F.max("event_time").alias("last_event_time"), F.count("*").alias("trade_count"), F.count_if(F.col("kind") == "sweep").alias("sweep_count"), F.sum("notional").alias("notional")
    )


def absorption(levels: DataFrame, bucket_seconds: int, by: Sequence[str] = ("market", "symbol"), min_hits: int = 2, min_one_sided: float = 0.8, min_cover: float = 0.5) -> DataFrame:
    """Levels hit often, from one side, through most of the bucket, with the bucket's close still at the level's
    side: candidates only. Progress is the bucket's last level against its first."""
    w = Window.partitionBy(*by, "bucket_start")
    cover = (F.unix_micros(F.col("last_event_time").cast("timestamp")) - F.unix_micros(F.col("first_event_time").cast("timestamp"))) / (1e6 * bucket_seconds)
    one_sided = ratio(F.abs("delta"), F.col("volume"))
    first = F.min_by("price", F.struct("first_event_time", "price")).over(w)
    last = F.max_by("price", F.struct("last_event_time", "price")).over(w)
    out = levels.withColumns({"cover": cover, "one_sided": one_sided, "progress": last - first})
    held = F.when(F.col("delta") > 0, F.col("progress") <= 0).otherwise(F.col("progress") >= 0)
    return out.where((F.col("trade_count") >= min_hits) & (F.col("one_sided") >= min_one_sided) & (F.col("cover") >= min_cover) & held).select(*by, "bucket_start", "price", "delta", "volume", "trade_count", "cover", "one_sided", "progress")


def exhaustion(buckets: DataFrame, by: Sequence[str], decay: int = 2) -> DataFrame:
    """Buckets at a new high or low of the window while volume and the size of the delta have fallen over the last
    `decay` steps: candidates only."""
    w = Window.partitionBy(*by).orderBy("bucket_start")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    falling = F.lit(True)
    for k in range(decay):
        older = [F.lag(c, k + 1).over(w) for c in ("volume", "size")]
        newer = [F.lag(c, k).over(w) for c in ("volume", "size")] if k else [F.col("volume"), F.col("size")]
        falling = falling & (newer[0] < older[0]) & (newer[1] < older[1])
    out = buckets.withColumn("size", F.abs("taker_delta"))
    out = out.withColumns({"falling": falling, "top": F.max("high").over(before), "bottom": F.min("low").over(before)})
    kind = F.when(F.col("high") > F.col("top"), "high").when(F.col("low") < F.col("bottom"), "low")
    return out.where("falling").withColumn("extreme", kind).where("extreme is not null").select(*by, "bucket_start", "extreme", "high", "low", "volume", "taker_delta")


def regimes(buckets: DataFrame, interest: DataFrame, bucket_seconds: int, by: Sequence[str]) -> DataFrame:
    """What net taker delta and the change of open interest say together, per bucket. interest has open_interest
    by bucket_start; a step that is not exactly one bucket long is not classified."""
    w = Window.partitionBy(*by).orderBy("bucket_start")
    step = F.unix_seconds(F.col("bucket_start").cast("timestamp")) - F.unix_seconds(F.lag("bucket_start").over(w).cast("timestamp"))
    change = interest.select(*by, "bucket_start", F.when(step == bucket_seconds, F.col("open_interest") - F.lag("open_interest").over(w)).alias("interest_change"))
    both = buckets.select(*by, "bucket_start", "taker_delta").join(change, [*by, "bucket_start"])
    buy, up = F.col("taker_delta") > 0, F.col("interest_change") > 0
    known = F.col("interest_change").isNotNull() & (F.col("interest_change") != 0) & (F.col("taker_delta") != 0)
    name = F.when(~known, "unclassified").when(buy & up, "longs_opened").when(buy, "shorts_closed").when(up, "shorts_opened").otherwise("longs_closed")
    return both.withColumn("regime", F.coalesce(name, F.lit("unclassified")))


def lead_lag(buckets: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Spot and futures flow side by side, bucket by bucket, with each market's volume against its own mean."""
    w = Window.partitionBy("market", *by)
    out = buckets.select("market", *by, "bucket_start", "taker_delta", ratio(F.col("volume"), F.avg("volume").over(w)).alias("expansion"))
    spot, um = (out.where(F.col("market") == m).drop("market").withColumnsRenamed({"taker_delta": f"{m}_delta", "expansion": f"{m}_expansion"}) for m in ("spot", "um"))
    both = spot.join(um, [*by, "bucket_start"])
    return both.withColumn("leader", F.when(F.col("spot_expansion") > F.col("um_expansion"), "spot").when(F.col("spot_expansion") < F.col("um_expansion"), "um").otherwise("none"))


def wash_screen(levels: DataFrame, by: Sequence[str] = ("market", "symbol")) -> DataFrame:
    """Per price level: net and gross delta over the window's buckets and how many buckets it is in."""
    out = levels.groupBy(*by, "price").agg(
        F.sum("delta").alias("net_delta"), F.sum(F.abs("delta")).alias("gross_delta"), F.count("*").alias("bucket_count"), F.sum("trade_count").alias("hit_count"), F.sum("volume").alias("volume")
    )
    return out.withColumn("net_over_gross", ratio(F.col("net_delta"), F.col("gross_delta")))


def roundness(price: Column) -> Column:
    """How round a price is: its whole tens, whole units, tenths or less."""
    return F.when(F.pmod(price, F.lit(10.0)) == 0, 3).when(F.pmod(price, F.lit(1.0)) == 0, 2).when(F.round(price * 10, 6) == F.round(price * 10, 0), 1).otherwise(0)


def roundness_baseline(levels: DataFrame, by: Sequence[str] = ("market", "symbol")) -> DataFrame:
    """Each level's hits against the mean of levels of the same roundness."""
    hits = levels.groupBy(*by, "price").agg(F.sum("trade_count").alias("hit_count")).withColumn("roundness", roundness(F.col("price")))
    return hits.withColumn("hits_over_class_mean", ratio(F.col("hit_count").cast("double"), F.avg("hit_count").over(Window.partitionBy(*by, "roundness"))))


def exact_quantile(df: DataFrame, value: str, share: float, by: Sequence[str], name: str) -> DataFrame:
    """The interpolated quantile of each group, exactly: every group has one, null keys are one key and nulls are no
    values. A sketch brackets it, so only distinct values within a few ten-thousandths of the rank are put in order, with
    their counts; no group's values are gathered. df is made once."""
    slack = 2 / ACCURACY
    low, high = max(0.0, share - slack), min(1.0, share + slack)
    bracket = F.percentile_approx(value, F.array(F.lit(low), F.lit(high)), F.lit(ACCURACY))
    rows = stored(df.select(*by, value))
    # Groups of few rows, in which a rank is more than the slack, are taken whole.
    ends = rows.groupBy(*by).agg(F.count(value).alias("n"), bracket.alias("b"), F.min(value).alias("least"), F.max(value).alias("most"))
    few = F.col("n") <= ACCURACY
    first, last = F.when(few | F.lit(low == 0), F.col("least")).otherwise(F.col("b")[0]), F.when(few | F.lit(high == 1), F.col("most")).otherwise(F.col("b")[1])
    ends = ends.select(*by, "n", first.alias("from"), last.alias("to"))
    met = beside(rows, ends, by).where(F.col(value).isNull() | (F.col(value) <= F.col("to")))
    # The values below the bracket are one row without a value, the first of its group.
    inside = met.groupBy(*by, "n", F.when(F.col(value) >= F.col("from"), F.col(value)).alias(value)).agg(F.count(value).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first(value)))
    placed = inside.withColumn("last", upto).withColumn("place", F.lit(share) * (F.col("n") - 1))
    first = F.col("last") - F.col("c")
    holds = lambda at: F.max(F.when((first <= at) & (at < F.col("last")), F.col(value)))
    out = placed.groupBy(*by).agg(holds(F.floor("place")).alias("a"), holds(F.ceil("place")).alias("z"), F.first("place").alias("place"))
    part = F.col("place") - F.floor("place")
    return out.select(*by, F.when(part > 0, F.when(F.col("z").isNotNull(), between_values(F.col("a"), F.col("z"), part))).otherwise(F.col("a")).alias(name))


def notional_floor(tape: DataFrame, dataset: str, share: float = 0.999, by: Sequence[str] = ("market", "symbol")) -> DataFrame:
    """The notional that a share of the trades stays below."""
    rows = scoped(tape, dataset).select(*by, (F.col("price") * F.col("qty")).alias("notional"))
    return exact_quantile(rows, "notional", share, by, "notional_floor")
