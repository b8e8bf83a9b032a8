r"""Resampling towards a target corpus by the importance of hashed n-grams.

A text's features are its runs of one to two words, hashed into buckets. A bucket's gain is the log ratio of the two
corpora's shares of it, and a text's weight is the mean gain of its features; Gumbel noise on the weights
makes the highest scores a draw without replacement.

Postings are inverted: each slice of texts gives, for each range of buckets, its (bucket, text, count) in that
order, packed into arrays. They are shuffled by range of buckets (and salted by slice, so that a bucket
that all texts have is many groups), meet the gains that were made from both corpora's counts of those buckets, and
leave as contributions, which are summed up by text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import by_bytes, staged, text_slices
from .decontamination import plain_words
from .ranks import numbered

#: Ranges of buckets.
RANGES = 16
#: Texts of a slice at most, so that 16 bits number them.
SLICE_TEXTS = 1 << 16
#: Packed postings of one range that a task takes at once.
GROUP_BYTES = 8 << 20


def feature_buckets(texts: pa.Array, n_buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of one to `longest` consecutive words: its text and its bucket. And each text's words."""
    words, counts = plain_words(texts)
    coded = words.dictionary_encode()
    vocabulary = coded.dictionary.cast(pa.binary()).to_pylist()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)[doc]
    at = np.arange(len(ids))
    hashes = np.fromiter(map(zlib.crc32, vocabulary), np.uint32, len(vocabulary))[ids]
    found = [(doc, hashes)]
    # A checksum goes on where it ended: of a run and one more word.
    spaced = [b" " + w for w in vocabulary]
    for size in range(2, longest + 1):
        at, hashes = at[at + size <= ends[at]], hashes[: len(at)][at + size <= ends[at]]
        more = ids[at + size - 1].tolist()
        hashes = np.fromiter(map(zlib.crc32, map(spaced.__getitem__, more), hashes.tolist()), np.uint32, len(at))
        found.append((doc[at], hashes))
    return np.concatenate([d for d, _ in found]), np.concatenate([h for _, h in found]) % np.uint32(n_buckets), counts


def narrow(x: np.ndarray) -> bytes:
    """As little-endian unsigned integers of the least width that holds them all."""
    top = int(x.max(initial=0))
    return x.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if top < 1 << 8 * w)).tobytes()


def wide(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def postings(src: DataFrame, corpus: int, n_buckets: int, longest: int) -> DataFrame:
    """Of (id, text), for each slice: a row with range -1 and its texts' ids and numbers of words, and a row for each
    range of buckets with the texts in each bucket and how often it is in them."""
    kind = src.schema["id"].dataType.simpleString()
    schema = f"corpus int, slice long, range int, ids array<{kind}>, n_words array<long>, n_features array<long>, sizes binary, texts binary, times binary"
    edges = -(-np.arange(RANGES + 1) * n_buckets // RANGES)

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for big in text_slices(batches, "text"):
            for b in (big.slice(k, SLICE_TEXTS) for k in range(0, big.num_rows, SLICE_TEXTS)):
                doc, bucket, words = feature_buckets(b.column(1), n_buckets, longest)
                features = np.bincount(doc, minlength=len(words))
                cells, times = np.unique(bucket.astype(np.int64) * len(words) + doc, return_counts=True)
                bucket, doc = cells // max(1, len(words)), cells % max(1, len(words))
                cuts = np.searchsorted(bucket, edges)
                rows = [{"corpus": corpus, "slice": number, "range": -1, "ids": b.column(0).to_pylist(), "n_words": words, "n_features": features}]
                for r, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    if i < j:
                        sizes = np.bincount(bucket[i:j] - edges[r], minlength=edges[r + 1] - edges[r])
                        rows.append({"corpus": corpus, "slice": number, "range": r, "sizes": narrow(sizes), "texts": narrow(doc[i:j]), "times": narrow(times[i:j])})
                yield pa.RecordBatch.from_pylist(rows, arrow_schema)
                number += 1

    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))
    return by_bytes(src).mapInArrow(run, schema)


def bucket_counts(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, corpus, n): how often a corpus has each bucket, summed up within tasks first."""
    edges = -(-np.arange(RANGES + 1) * n_buckets // RANGES)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for row in b.to_pylist():
                r = row["range"]
                sizes = wide(row["sizes"], int(edges[r + 1] - edges[r]))
                have = np.flatnonzero(sizes)
                first = np.cumsum(sizes)[have] - sizes[have]
                sums = total.setdefault(row["corpus"], np.zeros(n_buckets, np.int64))
                sums[edges[r] + have] += np.add.reduceat(wide(row["times"], int(sizes.sum())), first)
        for corpus, sums in total.items():
            have = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(np.full(len(have), corpus, np.int32)), pa.array(sums[have])], ["bucket", "corpus", "n"])

    parts = blocks.select("corpus", "range", "sizes", "times").mapInArrow(run, "bucket long, corpus int, n long")
    return parts.groupBy("bucket", "corpus").agg(F.sum("n").alias("n"))


def floor_div(a: Column, b: Column) -> Column:
    """floor(a / b) of whole numbers, b above 0."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def importance_scores(docs: DataFrame, target: DataFrame, n_buckets: int = 10000, longest: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(id, slice, nth, n_words, n_features, weight, score) of each row of docs, as a table in the shared folder."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    goal = target.select(F.lit(None).cast(src.schema["id"].dataType).alias("id"), target[target_text_col].alias("text"))
    found = staged(postings(src, 0, n_buckets, longest).unionByName(postings(goal, 1, n_buckets, longest)))
    heads, blocks = found.where("range < 0"), found.where("range >= 0")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("corpus") == c, F.aggregate("n_features", F.lit(0).cast("long"), lambda a, x: a + x))), F.lit(0))
    n_source, n_target = heads.agg(total(0), total(1)).first()
    packed = blocks.where("corpus = 0").agg(F.sum(F.length("texts") + F.length("times"))).first()[0] or 0
    salts = -(-packed // (RANGES * GROUP_BYTES)) or 1

    both = bucket_counts(blocks, n_buckets).groupBy("bucket").agg(*[F.coalesce(F.sum(F.when(F.col("corpus") == c, F.col("n"))), F.lit(0)).cast("double").alias(x) for c, x in enumerate("st")])
    ratio = ((F.col("t") + 1) * F.lit(float(n_source + n_buckets))) / ((F.col("s") + 1) * F.lit(float(n_target + n_buckets)))
    gains = staged(both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"), F.floor(F.col("bucket") * RANGES / n_buckets).cast("int").alias("range")))
    edges = -(-np.arange(RANGES + 1) * n_buckets // RANGES)

    def contribute(held: pa.Table, known: pa.Table) -> pa.Table:
        out = {"slice": [], "sums": []}
        for row in held.to_pylist():
            r = row["range"]
            gain = np.zeros(edges[r + 1] - edges[r], np.int64)
            gain[known["bucket"].to_numpy() - edges[r]] = known["gain"].to_numpy()
            sizes = wide(row["sizes"], len(gain))
            n = int(sizes.sum())
            texts = wide(row["texts"], n)
            # Whole numbers below 2**53, so sums of doubles are exact.
            sums = np.bincount(texts, np.repeat(gain, sizes) * wide(row["times"], n))
            out["slice"].append(row["slice"])
            out["sums"].append(sums.astype(np.int64))
        return pa.Table.from_pydict(out, pa.schema([("slice", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    group = ["range", "salt"]
    left = blocks.where("corpus = 0").select("slice", "range", "sizes", "texts", "times", F.pmod("slice", F.lit(salts)).alias("salt"))
    right = gains.select("bucket", "gain", "range", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    parts = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(contribute, "slice long, sums array<long>")
    # The last text of a slice may lack a range's buckets, so arrays are of unlike lengths.
    plus = lambda a, x: F.zip_with(a, x, lambda p, q: F.coalesce(p, F.lit(0)) + F.coalesce(q, F.lit(0)))
    sums = parts.groupBy("slice").agg(F.collect_list("sums").alias("all")).select("slice", F.aggregate("all", F.array().cast("array<long>"), plus).alias("sums"))
    rows = heads.where("corpus = 0").select("slice", "ids", "n_words", "n_features").join(sums, "slice", "left")
    rows = rows.select("slice", "sums", "n_words", "n_features", F.posexplode("ids").alias("nth", "id"))
    at = lambda c: F.coalesce(F.get(c, F.col("nth")), F.lit(0))
    rows = rows.select("id", "slice", "nth", at("n_words").alias("n_words"), at("n_features").alias("n_features"), at("sums").alias("total"))
    weight = F.when(F.col("n_features") > 0, floor_div(F.col("total"), F.col("n_features"))).otherwise(F.lit(0).cast("long"))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return staged(rows.select("id", "slice", "nth", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, id_col: str = "doc_id", **how) -> DataFrame:
    """A row for each row of docs: id_col, n_words, n_features, weight, score and rank, from 1 for the highest score, of
    those drawn: floor(percent * N / 100) of the N texts with least_words words or more. Others' rank is null.

    Null and empty texts, and those without words, have no features and weight 0. Equal scores go by the smaller id,
    null ids last and with the noise of an empty one, then by the place in the input; repeated rows are rows of their
    own. An empty target counts as having no feature, and empty docs give no rows. Other columns are not read. A word
    of any length is one. One text is one slice, whatever its size. how: as importance_scores takes it.
    """
    rows = importance_scores(docs, target, id_col=id_col, **how)
    fit = rows.where(F.col("n_words") >= least_words)
    n_drawn = percent * fit.count() // 100
    placed = numbered(fit, [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("slice").asc(), F.col("nth").asc()])
    rank = F.when(F.col("place") < n_drawn, F.col("place") + 1)
    rest = rows.where(F.col("n_words") < least_words).withColumn("place", F.lit(n_drawn).cast("long"))
    return placed.unionByName(rest).select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", rank.alias("rank"))
