"""Token ids in flat binary files with 64-bit document offsets, written in id order and memory-mapped back.

A part is two files: `.bin` holds its documents' ids as unsigned integers (16 bits where the vocabulary
allows, else 32) with nothing between them; `.idx` holds six little-endian 64-bit numbers (magic, version,
bytes per id, documents, null ids, tokens), then the documents' ids, then documents + 1 offsets into the part.
The manifest, a table beside the parts, names each part's files and its sizes; prefix sums over it give each
part's base in the whole. A task that runs again writes new files; only those of the run whose manifest row
was committed are ever read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, partitions_for, shared_dir, text_slices
from .files import mapped, open_output
from .tokenization import ENCODED_BYTES, encode

MAGIC, VERSION, HEADER = 0x5449444554584944, 1, 6
MANIFEST = "part int, name string, width int, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes every whole text's ids, with end_id appended, in ascending id order; returns the folder's URI.

    id_col holds integers; null ids come first, and rows of equal ids are in the order of a hash of their texts.
    Null and empty texts have end_id alone. An empty table gives a folder with an empty manifest. Other
    columns are not read. One shuffle, by range of (id, hash of text, place in the input): a single id
    with very many rows is still split over many parts.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    uri = uri or shared_dir(spark)
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(True) - 1, end_id) < 1 << 16 else 4
    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    n_bytes = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = ["id", "h", "place"]
    src = src.withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ranged = src.repartitionByRange(partitions_for(spark, n_bytes), *keys).sortWithinPartitions(*keys).select("id", "text")

    def run(batches):
        part = TaskContext.get().partitionId()
        name = f"part-{part:07d}-{uuid.uuid4().hex}"
        ids, sizes, nulls, out = [], [], 0, None
        for b in text_slices(batches, "text", 2 * ENCODED_BYTES):
            out = out or open_output(f"{uri}/{name}.bin")
            tokens, n = encode(b.column(1), tokenizer)
            ends = np.cumsum(n)
            out.write(np.insert(tokens, ends, end_id).astype(f"<u{width}").tobytes())
            ids.append(b.column(0).fill_null(0).to_numpy())
            nulls += b.column(0).null_count
            sizes.append(n + 1)
        if out is None:
            return
        out.close()
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        offsets = np.r_[0, np.cumsum(sizes)]
        head = np.array([MAGIC, VERSION, width, len(ids), nulls, offsets[-1]])
        with open_output(f"{uri}/{name}.idx") as f:
            f.write(np.concatenate([head, ids, offsets]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "width": pa.array([width], pa.int32()), "n_docs": [len(ids)], "n_tokens": [int(offsets[-1])]})

    by_bytes(ranged).mapInArrow(run, MANIFEST).write.parquet(f"{uri}/manifest")
    return uri


def read_token_files(spark: SparkSession, uri: str, with_ids: bool = False) -> DataFrame:
    """A row per document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of its ids as little-endian unsigned 32-bit numbers) and, if wanted, ids."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # The manifest has one row for each part, so one task adds its sizes up.
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                numbers = mapped(f"{uri}/{row['name']}.idx", "<i8")
                magic, version, width, n_docs, nulls, n_tokens = numbers[:HEADER].tolist()
                if (magic, version) != (MAGIC, VERSION):
                    raise ValueError(f"{row['name']}.idx is not a token index")
                doc_ids, offsets = numbers[HEADER : HEADER + n_docs], numbers[HEADER + n_docs :]
                flat = mapped(f"{uri}/{row['name']}.bin", f"<u{width}", count=n_tokens)
                for k in range(0, n_docs, 4096):
                    m = min(4096, n_docs - k)
                    at = offsets[k : k + m + 1]
                    wide = flat[at[0] : at[-1]].astype("<u4")
                    cuts = (at - at[0]).tolist()
                    view = memoryview(wide).cast("B")
                    crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(cuts, cuts[1:])]
                    out = [pa.array(doc_ids[k : k + m], mask=np.arange(k, k + m) < nulls), pa.array(row["base"] + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                    if with_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(wide.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return based.select("part", "name", "base").repartition(n, "part").select("name", "base").mapInArrow(run, schema)
