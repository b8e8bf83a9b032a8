"""Multiplicities of rows before and after, and coverage by level, against plain counts."""

from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators.catalog import coverage_levels
from tidemark.operators.core import changes


def test_changes_of_repeated_rows_and_nulls(spark):
    a = [("x", 1.0)] * 3 + [(None, 2.0)] * 2 + [("y", None), (None, None), ("z", float("nan"))]
    b = [("x", 1.0), (None, 2.0), (None, 2.0), (None, 2.0), ("new", 0.0), (None, None), ("z", float("nan"))]
    columns = "k string, v double"
    got = {(r.k, str(r.v)): (r.n_before, r.n_after, r.n_removed, r.n_added, r.n_kept) for r in changes(spark.createDataFrame(a, columns), spark.createDataFrame(b, columns)).collect()}
    n, m = (Counter((k, str(v)) for k, v in rows) for rows in (a, b))
    assert got == {k: (n[k], m[k], (n - m)[k], (m - n)[k], (n & m)[k]) for k in n | m}
    none = spark.createDataFrame([], columns)
    assert changes(none, none).isEmpty()


def test_one_row_is_a_third_of_all(spark):
    big = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"))
    out = changes(big, big.where("v = 0 or v % 2 = 0"))
    assert out.where("v = 0").select("n_before", "n_after", "n_kept").first() == (20_000, 20_000, 20_000)
    assert out.where("n_removed > 0").count() == 20_000 and out.where("n_added > 0").isEmpty()


def test_coverage_by_level(spark):
    rows = [("a", "m", "s", 5, 10, "2025-01-01", "2025-01-03"), ("a", "m", "s", 7, 10, "2025-01-03", "2025-01-04"), ("a", None, "s", 1, 10, "2025-01-04", "2025-01-04"), ("b", None, None, 2, 10, None, None), ("b", None, None, 3, 10, "2025-02-01", "2025-01-01")]
    files = spark.createDataFrame(rows, "dataset string, market string, symbol string, row_count long, file_size_bytes long, a string, b string")
    files = files.withColumns({"min_event_time": F.col("a").cast("timestamp_ntz"), "max_event_time": F.col("b").cast("timestamp_ntz")})
    got = {tuple(r[:4]): tuple(r[4:]) for r in coverage_levels(files).collect()}
    assert got == {
        (0, None, None, None): (5, 18, 50, 4),
        (1, "a", None, None): (3, 13, 30, 4),
        (1, "b", None, None): (2, 5, 20, 0),
        (2, "a", "m", None): (2, 12, 20, 4),
        (2, "a", None, None): (1, 1, 10, 1),
        (2, "b", None, None): (2, 5, 20, 0),
        (3, "a", "m", "s"): (2, 12, 20, 4),
        (3, "a", None, "s"): (1, 1, 10, 1),
        (3, "b", None, None): (2, 5, 20, 0),
    }
