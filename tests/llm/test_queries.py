"""The registered corpus queries against their SQL and contracts on the driver's tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_are_those_of_the_sql(spark, duck, name):
    out = queries.queries()[name](spark, SF)
    names = sorted(out.columns)
    result = duck.execute(queries.oracle_sql()[name])
    have = [d[0] for d in result.description]
    assert sorted(have) == names
    want = sorted((tuple(r[have.index(c)] for c in names) for r in result.fetchall()), key=str)
    assert sorted(map(tuple, out.select(*names).collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"op8_packing", "op12_prefix_trie"}))
def test_each_document_has_a_row(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.queries()[name](spark, SF).select("doc_id")
    assert got.exceptAll(docs.select("doc_id")).isEmpty() and docs.select("doc_id").exceptAll(got).isEmpty()


def test_packed_pieces_are_whole(spark):
    """Pieces follow one another in their documents and in their sequences, without a gap."""
    out = queries.queries()["op8_packing"](spark, SF).persist()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("end"), F.max("piece").alias("last"), F.count("*").alias("pieces"))
    assert whole.count() == docs.count() and whole.where("n <> end or last + 1 <> pieces").isEmpty()
    bins = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("places"), F.count("*").alias("pieces"))
    assert bins.where("n <> end or n > 1024 or places <> pieces").isEmpty()
    least = -(-out.agg(F.sum("length")).first()[0] // 1024)
    assert bins.count() <= 1.02 * least + 1
    out.unpersist()
