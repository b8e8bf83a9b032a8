"""Shared plumbing: the folder all executors see, bounded batches, and words as numpy arrays."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder as shared_dir

#: UTF-8 bytes of text that one in-memory slice holds (a longer text is a slice of its own).
SLICE_BYTES = 2 << 20

#: The bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_LIBC = ctypes.CDLL(None)

MULT = np.uint64(0x9E3779B97F4A7C15)


#: While it is on, Spark deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again: later stages neither recompute it
    nor depend on the executors that made it, so its shuffle files go. The path is kept in `.staged_at`."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Partitions of a shuffle at most: the driver keeps a number for each pair of a map task and a partition.
MOST_PARTITIONS = 1 << 16


def partitions_for(spark: SparkSession, n_bytes: int, target: int = 32 << 20) -> int:
    """Partitions of about `target` bytes each, never fewer than the session's default, and not more than
    MOST_PARTITIONS: beyond 2 TB they grow instead, to 1.5 GB each at 100 TB, which tasks sort on disk and stream."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-n_bytes // target), MOST_PARTITIONS))


def by_bytes(df: DataFrame) -> DataFrame:
    """df; its session sends Python workers Arrow batches of at most SLICE_BYTES from now on, or fewer where it does
    so already: a batch of a fixed number of long texts has no bound."""
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(BATCH_BYTES)) or 0) > SLICE_BYTES:
        conf.set(BATCH_BYTES, str(SLICE_BYTES))
    return df


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows as batches of at most `limit` bytes of text (or one row); small batches are joined."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        while start < len(lens):
            ends = np.cumsum(lens[start:], dtype=np.int64)
            n = int(np.searchsorted(ends, limit - size, side="right"))
            if n == 0 and not held:
                n = 1
            if n:
                held.append(batch.slice(start, n))
                size += int(ends[n - 1])
                start += n
            if start < len(lens):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
                give_back()
    if held and (out := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield out[0]
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers live on, and each keeps what its largest slice took."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def filled(texts: pa.Array) -> pa.Array:
    """Texts with null as empty, at offset 0 of buffers of their own."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    return pa.concat_arrays([texts, pa.array([], pa.string())]) if texts.offset else texts


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    r"""All words `[^\x20\x09-\x0D]+` in order, and each text's number of words."""
    parts = pc.ascii_split_whitespace(filled(texts))
    flat, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    keep = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if not keep.all():
        flat, doc = flat.filter(pa.array(keep)), doc[keep]
    return flat, np.bincount(doc, minlength=len(sizes)).astype(np.int64)


def word_ids(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each word's place among the distinct words, and those."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def hash_words(vocabulary: list[str], seed: int = 0) -> np.ndarray:
    """64-bit hashes, the same in every process; another seed gives others."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in vocabulary), np.uint64, len(vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Worths:
    """Numbers for items: a hash table in two arrays, read for a whole batch in step."""

    FREE = np.iinfo(np.int64).max

    def __init__(self, items: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (2 * len(items)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.items, self.values = np.full(size, self.FREE), np.zeros(size)
        at, left = self.home(items), np.arange(len(items))
        while len(left):
            free = left[self.items[at[left]] == self.FREE]
            self.items[at[free]] = items[free]  # of several for one place the last stays
            stays = self.items[at[left]] == items[left]
            self.values[at[left[stays]]] = values[left[stays]]
            left = left[~stays]
            at[left] = (at[left] + 1) & (size - 1)

    def home(self, items: np.ndarray) -> np.ndarray:
        return (mix(items.view(np.uint64)) >> self.shift).astype(np.int64)

    def __call__(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items' numbers (0 for others), and which items are there."""
        out, known = np.zeros(len(items)), np.zeros(len(items), bool)
        at, left = self.home(items), None
        while left is None or len(left):
            here = at if left is None else at[left]
            held, want = self.items[here], items if left is None else items[left]
            hit, going = held == want, (held != want) & (held != self.FREE)
            if left is None:
                out[hit], known[hit], left = self.values[here[hit]], True, np.flatnonzero(going)
            else:
                out[left[hit]], known[left[hit]], left = self.values[here[hit]], True, left[going]
            at[left] = (at[left] + 1) & (len(self.items) - 1)
        return out, known


def rolling(h: np.ndarray, width: int, mult: np.uint64 = MULT) -> np.ndarray:
    """Rabin-Karp hashes (mod 2**64) of every run of `width` numbers: sum of h[i+k] * mult**(width-1-k)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, block, size = h.astype(np.uint64), mult, 1
    acc, done = None, 0
    with np.errstate(over="ignore"):
        # Low bits first: acc covers `done` numbers, the next block of `size` goes in front of it.
        rest = width
        while rest:
            if rest & 1:
                acc = power if acc is None else power[: len(acc) - size] * scale + acc[size:]  # noqa: F821
                done += size
                scale = np.uint64(pow(int(mult), done, 1 << 64))
            rest >>= 1
            if rest:
                power = power[: len(power) - size] * block + power[size:]
                block, size = block * block, size * 2
    return acc[:n]


def doc_windows(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts, in the joined words, of the windows that lie within one text; and their texts."""
    per = np.maximum(counts - width + 1, 0)
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), per)
    return first[doc] + ragged(per), doc


def ragged(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, joined."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array from joined values."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
