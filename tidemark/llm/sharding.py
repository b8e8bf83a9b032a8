"""Two-pass external shuffle into shards, by DataFrame functions alone.

Pass one scatters the records by a seeded hash into buckets that fit a task's memory. Pass two shuffles each
bucket (Spark's shuffle() is a Fisher-Yates shuffle) and writes it. A record's shard comes from its key by
rendezvous hashing: the shard with the greatest seeded hash of (key, shard) wins, so one shard more takes
records only into itself, and the key and the number of shards decide alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_PARTITIONS, shared_dir

#: Bytes of records in a bucket, on average.
BUCKET_BYTES = 4 << 20
#: Buckets of a shard that one task writes, to one file, at least.
RUN = 4

#: The buckets' bases are broadcast up to so many (24 bytes each), and joined by a shuffle beyond.
BROADCAST_BUCKETS = 200_000


def rendezvous(key: Column, n_shards: int, seed: int) -> Column:
    """The shard of a key. Null keys share one shard."""
    weigh = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("w"), F.lit(s).alias("s")) for s in range(n_shards)]
    return F.greatest(*weigh)["s"] if n_shards > 1 else F.lit(0)


def run_of(n_buckets: int) -> int:
    """Buckets that one task writes, to one file: RUN, or more where there would be more tasks than MOST_PARTITIONS (of
    1.5 GB each at 100 TB; a task holds 128 buckets of them at most before it sorts them on disk)."""
    return max(RUN, -(-n_buckets // MOST_PARTITIONS))


def shard_documents(docs: DataFrame, n_shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, uri: str | None = None) -> DataFrame:
    """Writes all records, shuffled, as Parquet under one folder per shard and returns them as read back.

    Columns: id_col, text_col, size (UTF-8 bytes of the text, null: none, plus 8), bucket, place (in the
    bucket), slot (gapless from 0 in each shard), shard, grown_shard (the shard if there were one more).
    Null ids share one shard; null and empty texts and repeated rows are records like others; an empty table
    gives an empty one. Other columns are not read. Equal texts go where their keys go: a group of them spreads
    over the shards, and those of one key share its shard. The scatter hashes id, text and the record's place in
    the input, so neither a hot key nor a group of equal records fills a bucket. The input must give the
    same rows again if it is read again (files or a staged table).
    """
    spark = docs.sparkSession
    uri = uri or shared_dir(spark)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    total = src.agg(F.sum(size)).first()[0] or 0
    per_shard = max(1, -(-total // (n_shards * bucket_bytes)))
    n_buckets = per_shard * n_shards
    scatter = F.pmod(F.xxhash64(F.lit(seed), F.lit("scatter"), "id", F.crc32("text"), F.monotonically_increasing_id()), F.lit(per_shard))
    records = src.select(
        "id",
        "text",
        rendezvous(F.col("id"), n_shards, seed).alias("shard"),
        rendezvous(F.col("id"), n_shards + 1, seed).alias("grown_shard"),
        scatter.alias("bucket"),
    )
    run = run_of(n_buckets)
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_buckets // run)
    records = records.withColumn("run", F.floor(F.col("bucket") / run))
    buckets = records.repartition(n_tasks, "shard", "run").groupBy("shard", "run", "bucket")
    # Sorted first, so that the seed decides the order alone and a task run again writes the same.
    shuffled = buckets.agg(F.shuffle(F.sort_array(F.collect_list(F.struct("id", "text", "grown_shard"))), seed).alias("r"))
    placed = shuffled.select("shard", "bucket", F.posexplode("r").alias("place", "r"))
    out = placed.select(F.col("r.id").alias("id"), F.col("r.text").alias("text"), F.col("r.grown_shard").alias("grown_shard"), "bucket", "place", "shard")
    out.write.partitionBy("shard").parquet(uri)
    written = spark.read.schema(out.schema).parquet(uri)
    # Counts of buckets, not records: each shard's run of them gives the buckets' bases.
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if n_buckets <= BROADCAST_BUCKETS:
        bases = F.broadcast(bases)
    return written.join(bases, ["shard", "bucket"]).select(
        F.col("id").alias(id_col),
        F.col("text").alias(text_col),
        size.alias("size"),
        "bucket",
        "place",
        (F.col("base") + F.col("place")).alias("slot"),
        "shard",
        "grown_shard",
    )
