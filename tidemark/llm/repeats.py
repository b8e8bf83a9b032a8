r"""Removal of word sequences that are found more than once in a corpus.

Every window of `width` consecutive words `[^\x20\x09-\x0D]+` has a Rabin-Karp hash of 128 bits, and the windows of
the same hash are counted in Spark. Most need not be sent for that. Each window has an anchor: the least, by a hash, of
the runs of about half as many words within it, the first of equal ones. Equal windows have equal anchors in the same
place, and neighbouring windows mostly share theirs, so there are few anchors beside the windows. Anchors are counted
first; a window whose anchor is found at one place only is unique. Of all others the hashes are counted, and those found
twice or more merge into maximal intervals of words per text.

A text that is there twice has all its windows repeated, so texts are told apart by their MD5, each is searched once
however many copies it has, and the intervals come back to the documents by it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULT, by_bytes, doc_windows, drop_staged, filled, hash_words, mix, rolling, split_words, staged, text_slices, word_ids

#: Bytes of intervals, or of anchors' places, that are broadcast at most.
BROADCAST_BYTES = 32 << 20
#: The second half of a window's hash has words' hashes of another seed, and another multiplier.
SEED, SECOND = 1, mix(np.array([MULT]))[0] | np.uint64(1)
#: A text's MD5 as two numbers.
NAME = ["d1", "d2"]
SPANS = "d1 long, d2 long, whole boolean, starts array<int>, ends array<int>"


def name_of(text: Column) -> list[Column]:
    """The MD5 of a text, or of the empty one, as two numbers."""
    both = F.unhex(F.md5(F.coalesce(text, F.lit(""))))
    half = lambda at: F.conv(F.hex(F.substring(both, at, 8)), 16, -10).cast("long")
    return [half(1).alias("d1"), half(9).alias("d2")]


def anchors(ids: np.ndarray, vocabulary: list[str], counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window in order: its start among all words, its text, its anchor's place there and the anchor's hash."""
    starts, doc = doc_windows(counts, width)
    run = anchor_words(width)
    h = mix(rolling(mix(hash_words(vocabulary))[ids], run))
    if not len(starts):
        return starts, doc, starts, np.empty(0, np.uint64)
    # The least of the first 1, 2, 4, ... runs from each place on, the first of equal ones.
    least, place, n, wanted = h, np.arange(len(h)), 1, width - run + 1
    while n < wanted:
        step = min(n, wanted - n)
        later = least[step:] < least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, least[step:], least[:-step])
        n += step
    return starts, doc, place[starts], least[starts]


def anchor_words(width: int) -> int:
    """Words of an anchor in windows of `width` words."""
    return min(width, (width + 5) // 2)


def sent_anchors(texts: DataFrame, width: int) -> DataFrame:
    """A staged table (h, d1, d2, place): the anchors of each text of texts (text), by their first word's place. Copies
    of a text in one partition are sent once."""

    def run(batches):
        seen: set[bytes] = set()
        for b in text_slices(batches, "text"):
            names = [hashlib.md5(t.encode()).digest() for t in filled(b.column(0)).to_pylist()]
            fresh = np.array([not (n in seen or seen.add(n)) for n in names], bool)
            words, counts = split_words(b.column(0).filter(pa.array(fresh)))
            _, doc, place, h = anchors(*word_ids(words), counts, width)
            new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.empty(0, int)
            doc, place, h = doc[new], place[new], h[new]
            name = np.frombuffer(b"".join(n for n, f in zip(names, fresh) if f), ">i8").reshape(-1, 2).astype(np.int64)
            first = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(name[doc, 0]), pa.array(name[doc, 1]), pa.array((place - first[doc]).astype(np.int32))], ["h", *NAME, "place"])

    return staged(by_bytes(texts).mapInArrow(run, "h long, d1 long, d2 long, place int"))


def shared_anchors(texts: DataFrame, width: int) -> DataFrame:
    """A staged table (d1, d2, places): in each text the anchors that are also found at another place of any text."""
    sent = sent_anchors(texts, width)
    counted = sent.groupBy("h").agg(*[f(c).alias(f"{n}_{c}") for c in (*NAME, "place") for n, f in (("least", F.min), ("most", F.max))])
    other = F.lit(False)
    for c in (*NAME, "place"):
        other |= F.col(f"least_{c}") != F.col(f"most_{c}")
    # Staged, so that Spark can split the rows of an anchor that very many texts have.
    shared = staged(counted.where(other).select("h"))
    out = staged(sent.join(shared, "h").groupBy(*NAME).agg(F.collect_set("place").alias("places")))
    drop_staged(sent)
    drop_staged(shared)
    return out


def counted_windows(texts: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """A staged table (d1, d2, at): the repeated windows of each text, from texts (text) and their shared anchors."""
    size = places.agg(F.sum(F.size("places") * 4 + 64)).first()[0] or 0
    named = texts.select(*name_of(F.col("text")), "text")
    met = named.join(F.broadcast(places) if size <= BROADCAST_BYTES else places, NAME)
    one = met.groupBy(*NAME).agg(F.first("text").alias("text"), F.first("places").alias("places"))

    def run(batches):
        for b in text_slices(batches, "text"):
            words, counts = split_words(b.column("text"))
            ids, vocabulary = word_ids(words)
            starts, doc, place, _ = anchors(ids, vocabulary, counts, width)
            first = np.cumsum(counts) - counts
            listed = b.column("places")
            known = np.zeros(len(ids) + 1, bool)
            known[first[np.repeat(np.arange(len(counts)), pc.list_value_length(listed).to_numpy(zero_copy_only=False))] + listed.flatten().to_numpy()] = True
            hit = known[place]
            starts, doc = starts[hit], doc[hit]
            w1 = mix(rolling(hash_words(vocabulary)[ids], width))[starts]
            w2 = mix(rolling(hash_words(vocabulary, SEED)[ids], width, SECOND))[starts]
            d1, d2 = (b.column(c).to_numpy()[doc] for c in NAME)
            yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(d1), pa.array(d2), pa.array((starts - first[doc]).astype(np.int32))], ["w1", "w2", *NAME, "at"])

    windows = staged(by_bytes(one).mapInArrow(run, "w1 long, w2 long, d1 long, d2 long, at int"))
    repeated = staged(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"))
    out = staged(windows.join(repeated, ["w1", "w2"]).groupBy(*NAME).agg(F.collect_list("at").alias("at")))
    drop_staged(windows)
    drop_staged(repeated)
    return out


def merged(starts: list[int], width: int) -> tuple[list[int], list[int]]:
    """Maximal intervals of the words that windows from `starts` cover."""
    at = np.unique(np.array(starts, np.int64))
    new = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + width])
    return at[new].tolist(), (at[np.r_[new[1:] - 1, len(at) - 1]] + width).tolist()


def repeated_spans(docs: DataFrame, width: int, text_col: str = "text") -> DataFrame:
    """A staged table (d1, d2, whole, starts, ends): of each text with a repeated window its name, and the maximal
    intervals of words [from, to); of a text that is there twice, that it is repeated as a whole."""
    texts = docs.select(docs[text_col].alias("text")).where("text is not null")
    places = shared_anchors(texts, width)
    windows = counted_windows(texts, places, width)
    copied = texts.select(*name_of(F.col("text"))).groupBy(*NAME).agg(F.count("*").alias("n")).where("n > 1")

    def run(batches):
        for b in batches:
            whole = pc.fill_null(pc.greater(b.column("n"), 1), False)
            found = [([], []) if w or at is None else merged(at, width) for w, at in zip(whole.to_pylist(), b.column("at").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in NAME), whole, *(pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1))], [*NAME, "whole", "starts", "ends"])

    out = staged(windows.join(copied, NAME, "full").select(*NAME, "n", "at").mapInArrow(run, SPANS))
    drop_staged(places)
    drop_staged(windows)
    return out


def remove_repeats(docs: DataFrame, width: int = 35, text_col: str = "text") -> DataFrame:
    """docs, all columns, with n_words, n_removed, removed (intervals of words) and kept: the words of the text
    that no repeated window covers, joined by one space.

    Null and empty texts have no words and an empty `kept`; texts of fewer than `width` words lose none. Rows
    that are there twice have all windows repeated. Columns of docs may have any names: the four new ones
    follow them, and a column that has such a name already is passed on beside it by position. A window's
    hash, and a text's MD5, has 128 bits.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    spans = repeated_spans(docs, width, text_col)
    src = docs.toDF(*names)
    # The intervals' bytes are known by now: few of them save a shuffle of all texts, many are joined by one.
    size = spans.agg(F.sum(F.size("starts") * 8 + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        spans = F.broadcast(spans)
    d1, d2 = name_of(src[names[at]])
    joined = src.withColumns({"d1": d1, "d2": d2}).join(spans, NAME, "left").select(*names, "whole", "starts", "ends")

    def cut(batches):
        for b in text_slices(batches, names[at]):
            words, counts = split_words(b.column(at))
            n, first = int(counts.sum()), np.cumsum(counts) - counts
            # A text that is there twice loses all its words, if it has a window at all.
            whole = pc.fill_null(b.column(len(names)), False).to_numpy(zero_copy_only=False) & (counts >= width)
            starts, ends = (c.to_pylist() for c in b.columns[len(names) + 1 :])
            for d in np.flatnonzero(whole).tolist():
                starts[d], ends[d] = [0], [int(counts[d])]
            edge = np.zeros(n + 1, np.int64)
            for d, (s, e) in enumerate(zip(starts, ends)):
                if s:
                    edge[first[d] + np.array(s, np.int64)] += 1
                    edge[first[d] + np.array(e, np.int64)] -= 1
            keep = np.cumsum(edge)[:-1] == 0
            doc = np.repeat(np.arange(len(counts)), counts)
            left = np.bincount(doc[keep], minlength=len(counts))
            offsets = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(left, out=offsets[1:])
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.filter(pa.array(keep))), " ")
            removed = pa.array([None if not s else [{"from": a, "to": z} for a, z in zip(s, e)] for s, e in zip(starts, ends)], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(counts), pa.array(counts - left), removed, kept], [*names, "n_words", "n_removed", "removed", "kept"])

    kinds = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in names)
    out = by_bytes(joined).mapInArrow(cut, f"{kinds}, n_words long, n_removed long, removed array<struct<from:int,to:int>>, kept string")
    return out.toDF(*docs.columns, "n_words", "n_removed", "removed", "kept")
