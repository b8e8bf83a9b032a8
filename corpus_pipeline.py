"""A corpus pipeline: quality rules, near-duplicate join, substring dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.decontamination import find_benchmark
from tidemark.llm.near_duplicates import digest, text_groups
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import keep_quality
from tidemark.llm.repeats import remove_repeats

END_ID = 2
#: Bytes of text that packing encodes at once: few, as its workers still hold memory of the stages before.
ENCODED_AT_ONCE = 1 << 20
#: Bytes of digests of (doc_id, text) to leave out that are broadcast at most, and of each; more are joined by a shuffle.
BROADCAST_BYTES, ID_BYTES = 64 << 20, 64


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts stays: that with the least doc_id, rows without an id last. Texts
    without words keep all their rows. Rows of one doc_id with unlike texts are each judged by their own text; of
    repeated rows of one doc_id and text, one stays: that which sorts first by all its columns."""
    named = docs.withColumn("__pair", digest(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), "text")))
    groups = text_groups(docs.select(F.col("doc_id").alias("id"), "text", digest(F.col("text")).alias("digest")))
    ids = named.where("text is not null").select("__pair", "doc_id", digest(F.col("text")).alias("digest"))
    pairs = ids.groupBy("__pair", "digest", F.col("doc_id").alias("id")).agg(F.count("*").alias("times"))
    linked = pairs.join(groups.where("n_shingles > 0").select("digest", "root"), "digest").select("root", F.struct(F.col("id").isNull().alias("no_id"), "id", "__pair").alias("place"), "times")
    least = staged(linked.groupBy("root").agg(F.min("place").alias("least"), F.sum("times").alias("rows")).where("rows > 1").drop("rows"))
    many = linked.join(least, "root").select("place.__pair", (F.col("place.__pair") == F.col("least.__pair")).alias("stays"), "times")
    marked = staged(many.where("not stays or times > 1").drop("times"))
    n, n_repeated = marked.agg(F.count("*"), F.count_if("stays")).first()
    if n * ID_BYTES <= BROADCAST_BYTES:
        marked = F.broadcast(marked)
    out = named.join(marked, "__pair", "left_anti").select(*docs.columns)
    if n_repeated:
        again = named.join(marked.where("stays"), "__pair", "left_semi").groupBy("__pair")
        out = out.union(again.agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return out


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeated windows cover are cut out of the texts; n_chars follows. A text of which nothing is
    left stays as an empty one, so that each document is still told of."""
    src, at = plain_names(docs)
    out = remove_repeats(src, text_col=at["text"])
    cut = F.col("n_removed") > 0
    fresh = {"text": F.when(cut, F.col("kept")).otherwise(F.col(at["text"]))}
    if "n_chars" in at:
        fresh["n_chars"] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"]))
    return out.select(*[fresh.get(c, F.col(at[c])).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; all others stay as they are."""
    src, at = plain_names(docs)
    found = find_benchmark(src, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text_col=at["text"])
    return found.where("not contaminated").select(*at.values()).toDF(*docs.columns)


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no operator's columns have, and those by the names before."""
    names = [f"column_{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of at most 1024 ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, at_once=ENCODED_AT_ONCE)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeats),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL cannot express the local search of packing; the tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
