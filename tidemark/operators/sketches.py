"""Sketches of a tape's files, made once when they are imported, which answer for any set of files without their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tape import ID

#: Of the sketch of values: a rank is known within RANK_ERROR of all rows, with 99 % certainty. Files of fewer rows are kept whole.
SIZE, RANK_ERROR = 8192, 0.0007
#: Of the sketch of ids, in powers of two: a count is known within about 2.5 % with 99 % certainty.
ID_SIZE = 14


def of_file(dataset: str) -> list[Column]:
    """The sketches of a file's trades: their notionals and their ids."""
    return [F.kll_sketch_agg_double(F.col("price") * F.col("qty"), SIZE).alias("notionals"), F.hll_sketch_agg(ID[dataset], F.lit(ID_SIZE)).alias("ids")]


def notional_quantiles(files: DataFrame, shares: Sequence[float], by: Sequence[str] = ("market", "symbol")) -> DataFrame:
    """by, row_count, trade_count (about: each id once, however often it was published) and quantiles, an array of the
    notionals that these shares of the rows stay below, about. files has row_count, notionals and ids of each file; their
    sketches merge in any order, in partial sums first. Rows without a notional are in row_count alone."""
    merged = files.groupBy(*by).agg(F.sum("row_count").alias("row_count"), F.kll_merge_agg_double("notionals").alias("all"), F.hll_union_agg("ids").alias("ids"))
    known = F.kll_sketch_get_n_double("all") > 0
    quantiles = F.array(*[F.when(known, F.kll_sketch_get_quantile_double("all", F.lit(float(s)))) for s in shares])
    return merged.select(*by, "row_count", F.hll_sketch_estimate("ids").alias("trade_count"), quantiles.alias("quantiles"))
