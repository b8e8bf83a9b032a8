"""The registered queries: each applies one operator to the whole of its tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .decontamination import find_benchmark
from .language import identify_language
from .language_model import score_texts
from .near_duplicates import near_duplicate_groups
from .packing import pack_documents
from .prefix_trie import prefix_trie
from .quality import quality_report
from .repeats import remove_repeats
from .resampling import resample
from .secrets import n_of, scan_secrets, written
from .sharding import shard_documents
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files

END_ID = 2


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(k: int):
    """crc32 of doc_id as text, mod k; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(k))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(remainder(3) == 1, F.lit(False)))
    out = identify_language(docs, docs.where(remainder(3) != 1), also=("held_out",))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir)).drop("failed_rule")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), byte_bpe())


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(documents(spark, sf_dir))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = find_benchmark(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(documents(spark, sf_dir), byte_bpe(), END_ID))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), byte_bpe(), END_ID)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(documents(spark, sf_dir), 24)
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(remainder(5) == 1, F.lit(False)))
    return score_texts(docs, remainder(5) != 1, also=("held_out",))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(documents(spark, sf_dir))
    counts = [n_of(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(documents(spark, sf_dir), benchmark).drop("n_words")


def queries() -> dict:
    return {"op1_language": op1, "op2_quality": op2, "op3_token_counts": op3, "op4_near_duplicates": op4, "op5_decontamination": op5, "op6_token_files": op6, "op7_repeats": op7, "op8_packing": op8, "op9_sharding": op9, "op10_language_model": op10, "op11_secrets": op11, "op12_prefix_trie": op12, "op13_resampling": op13}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": oracles.QUALITY, "op4_near_duplicates": oracles.NEAR_DUPLICATES, "op5_decontamination": oracles.DECONTAMINATION, "op7_repeats": oracles.REPEATS, "op11_secrets": oracles.SECRETS, "op12_prefix_trie": oracles.PREFIX_TRIE, "op13_resampling": oracles.RESAMPLING}
