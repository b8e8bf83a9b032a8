r"""Scoring texts by a pretrained byte-context model: prediction by partial matching.

The stream of a text is its words `[^\x20\x09-\x0D]+`, A-Z lower-cased, with a space between two and a line feed
at the end. Over all training texts the counts of every (context, byte) of ORDER bytes of context and fewer are
gathered in Spark: the trie, all of which is kept, so that it grows with the training texts. A byte's probability
is c / (t + d) in the longest context in which it was seen, times an escape d / (t + d) for each longer one, where
t and d count the context's bytes and distinct bytes; after an escape, the bytes of the longer context are
excluded. As a byte seen in a context was seen in all its suffixes, the escapes are a few numbers per context.

The trie is a table, never one object: all contexts of more than SHALLOW bytes that a byte string is looked up in end
in the same bytes, so the strings are dealt out by those, and each task makes the sub-tries below some of them; only
the top of the trie, whose size the number of bytes bounds, goes to all. What comes back is a table of worths: of each byte string
in the corpus its probability, and of each training word its smoothed unigram count, for the score beside it. Of
both, the commonest COMMON go to every worker, and the texts' rare ones are joined with the table.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Worths, by_bytes, drop_staged, filled, hash_words, partitions_for, split_words, staged, text_slices, word_ids

#: Bytes of context.
ORDER = 5
#: The pairs of contexts of so many bytes and fewer go to all tasks: at most 256**3 of 16 bytes, from which those of the
#: shorter ones follow. Byte strings whose contexts end in the same SHALLOW + 1 bytes are in one task.
SHALLOW = 2
#: Four times the byte strings of which the sub-tries are made at once, on average.
TASK_STRINGS = 200_000
#: Worths of byte strings, and of words, that go to every worker at most (16 bytes each); the others are joined.
COMMON = 1 << 20
#: Distinct items a task holds before it sends their counts, and bytes of text that are scored together.
HELD, SCORED_BYTES = 1 << 20, 1 << 20
NEWLINE = 10


def streams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """All texts' streams joined, where each starts, the words, and each text's number of words."""
    words, counts = split_words(pc.ascii_lower(filled(texts)))
    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    joined = pc.binary_join_element_wise(pc.binary_join(pa.ListArray.from_arrays(offsets, words), " "), "", "\n")
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    at = np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1]
    return np.frombuffer(joined.buffers()[2], np.uint8)[at[0] : at[-1]], (at[:-1] - at[0]).astype(np.int64), words, counts


def byte_strings(stream: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each byte and the ORDER before it as a number, the latest lowest; before a text stand line feeds."""
    gram = stream.astype(np.int64)
    for lag in range(1, ORDER + 1):
        gram[lag:] |= stream[:-lag].astype(np.int64) << (8 * lag)
    # The first ORDER places of a text look beyond its start: there the bytes before it are line feeds.
    sizes = np.diff(np.r_[starts, len(stream)])
    for place in range(ORDER):
        at = starts[sizes > place] + place
        lines = sum(NEWLINE << (8 * lag) for lag in range(place + 1, ORDER + 1))
        gram[at] = low_bytes(gram[at], place + 1) | lines
    return gram


def low_bytes(grams: np.ndarray, n: int) -> np.ndarray:
    return grams & ((1 << 8 * n) - 1)


def word_items(vocabulary: list[str]) -> np.ndarray:
    """Words as numbers below zero (62 bits of hash); byte strings are numbers from zero up."""
    return (hash_words(vocabulary) | np.uint64(3 << 62)).view(np.int64)


def find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted numbers among ascending values, and which are there."""
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


def summed(items: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct items, ascending, and the sums of their counts."""
    distinct, which = np.unique(items, return_inverse=True)
    return distinct, np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)


class ByteModel:
    """A trie as sorted arrays: for each depth the (context, byte) pairs seen and the contexts, with what scoring
    takes of each. A row is a pair that was seen, so the model is as large as the trie and not as an alphabet.

    Made from the counts of byte strings of ORDER + 1, from which those of the shorter ones follow; those of
    SHALLOW + 1 and fewer may come from counts of their own (`shallow`), where grams are only those of some
    contexts of SHALLOW bytes. A string is a number, the latest byte lowest; a pair's context is the number
    without its lowest byte.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, shallow: tuple[np.ndarray, np.ndarray] | None = None):
        self.levels = []
        for k in range(ORDER + 1):
            source, times = shallow if shallow is not None and k <= SHALLOW else (grams, counts)
            edges, count = summed(low_bytes(source, k + 1), times)
            nodes, of = np.unique(edges >> 8, return_inverse=True) if k else (np.zeros(1, np.int64), np.zeros(len(edges), np.int64))
            total, distinct = np.bincount(of, weights=count, minlength=len(nodes)), np.bincount(of, minlength=len(nodes))
            weight = np.log10(np.maximum(total + distinct, 1))
            escape = np.where(total > 0, np.log10(np.maximum(distinct, 1)) - weight, 0)
            rest = fall = np.zeros(len(nodes))
            if k:
                # What the suffix has beside the bytes seen here: its denominator, and the escape from there on.
                parent = np.searchsorted(above, low_bytes(nodes, k - 1))  # noqa: F821
                also = shorter[np.searchsorted(before, low_bytes(edges, k))]  # noqa: F821
                t = totals[parent] - np.bincount(of, weights=also, minlength=len(nodes))  # noqa: F821
                d = kinds[parent] - distinct  # noqa: F821
                rest = np.log10(np.maximum(t + d, 1))
                fall = np.where(d > 0, np.log10(np.maximum(d, 1)) - rest, 0) + falls[parent]  # noqa: F821
            above, totals, kinds, falls, before, shorter = nodes, total, distinct, fall, edges, count
            log_count = np.log10(count)
            self.levels.append((edges, log_count, log_count - weight[of], nodes, escape, rest, fall))
        self.never = -float(np.log10(max(256 - len(self.levels[0][0]), 1)))

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each string's last byte after the others."""
        at, seen = find(self.levels[ORDER][0], grams)
        out = self.levels[ORDER][2][at] if len(self.levels[ORDER][0]) else np.zeros(len(grams))
        out[~seen] = self.after_escapes(grams[~seen])
        return out

    def after_escapes(self, grams: np.ndarray) -> np.ndarray:
        out, n = np.empty(len(grams)), len(grams)
        left, inside = np.ones(n, bool), np.zeros(n, bool)  # without a result yet; within the longest context seen
        so_far, rest, fall = np.zeros(n), np.zeros(n), np.zeros(n)
        for k in range(ORDER, -1, -1):
            edges, log_count, own, nodes, escape, rests, falls = self.levels[k]
            edge, seen = find(edges, low_bytes(grams, k + 1))
            node, known = find(nodes, low_bytes(grams, k + 1) >> 8)
            lower, here = left & seen & inside, left & seen & ~inside
            out[lower] = so_far[lower] - fall[lower] + log_count[edge[lower]] - rest[lower]
            out[here] = own[edge[here]]
            left &= ~seen
            enters = left & known & ~inside
            so_far[enters] = escape[node[enters]] + falls[node[enters]]
            inside |= enters
            rest[known], fall[known] = rests[node[known]], falls[node[known]]
        out[left] = so_far[left] + self.never
        return out


def count_corpus(texts: DataFrame) -> DataFrame:
    """A staged table (item, n, m) over texts (text, learn): byte strings of ORDER + 1 in all texts and words of the
    training texts, how often they are there (n), and how often in training texts (m)."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            both, n = summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            # The lowest bit of a held item says whether the text is a training text.
            learnt = (both & 1) > 0
            return pa.RecordBatch.from_arrays([pa.array(both >> 1), pa.array(n), pa.array(np.where(learnt, n, 0))], ["item", "n", "m"])

        for b in text_slices(batches, "text"):
            stream, starts, words, counts = streams(b.column("text"))
            learn = b.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            of = np.repeat(learn, np.diff(np.r_[starts, len(stream)]))
            held.append(np.unique(byte_strings(stream, starts) << 1 | of, return_counts=True))
            ids, vocabulary = word_ids(words.filter(pa.array(np.repeat(learn, counts))))
            held.append((word_items(vocabulary) << 1 | 1, np.bincount(ids, minlength=len(vocabulary))))
            size += len(held[-1][0]) + len(held[-2][0])
            if size > HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counts = by_bytes(texts).mapInArrow(run, "item long, n long, m long")
    return staged(counts.groupBy("item").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))


def byte_worths(grams: DataFrame, n_grams: int) -> DataFrame:
    """(item, worth, n): the log10 probability of each byte string of grams (item, n, m)."""
    spark = grams.sparkSession
    low = F.col("item").bitwiseAND((1 << 8 * (SHALLOW + 1)) - 1)
    top = grams.where("m > 0").groupBy(low.alias("edge")).agg(F.sum("m").alias("m")).toArrow()
    shared = spark.sparkContext.broadcast((top["edge"].to_numpy(), top["m"].to_numpy()))

    def run(table: pa.Table) -> pa.Table:
        items, m = table["item"].to_numpy(), table["m"].to_numpy()
        model = ByteModel(items[m > 0], m[m > 0], shared.value)
        return pa.table([table["item"], pa.array(model.log_probability(items)), table["n"]], names=["item", "worth", "n"])

    above = F.shiftright("item", 8).bitwiseAND((1 << 8 * (SHALLOW + 1)) - 1)
    n_tasks = partitions_for(spark, 4 * n_grams, TASK_STRINGS)
    dealt = grams.withColumn("task", F.pmod(F.xxhash64(above), F.lit(n_tasks)))
    return dealt.groupBy("task").applyInArrow(run, "item long, worth double, n long")


def common_worths(worths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The worths of the items found most often, at most COMMON of them."""
    power = F.floor(F.log2("n")).cast("int")
    sizes = dict(worths.groupBy(power.alias("p")).count().collect())
    least, total = 64, 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > COMMON:
            break
        least = p
    rows = worths.where(power >= least).select("item", "worth").toArrow()
    return rows["item"].to_numpy(), rows["worth"].to_numpy()


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """n_tokens (words and one end), n_known, train_tokens, base_score and score of every whole text.

    training: a condition on docs that holds for the texts to learn from. score is the byte model's log10
    probability of the text's stream; base_score sums log10((c + 0.5) / (N + 0.5 * (V + 1))) over its tokens.
    Null and empty texts are the end alone. Without training texts all counts are 0 and bytes equally likely.
    Repeated rows and null ids give rows of their own. Only id_col, text_col, the columns in `also`, which are
    passed on, and those of the condition are read. Words are told apart by 62-bit hashes.
    """
    spark = docs.sparkSession
    learn = F.coalesce(training, F.lit(False))
    src = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("__text"), *[docs[c] for c in also])
    n_texts = docs.where(learn).count()
    counts = count_corpus(docs.select(docs[text_col].alias("text"), learn.alias("learn")))
    n_words, n_distinct, n_grams = counts.agg(F.coalesce(F.sum(F.when(F.col("item") < 0, F.col("m"))), F.lit(0)), F.count_if(F.col("item") < 0), F.count_if(F.col("item") >= 0)).first()
    total, distinct = n_words + n_texts, n_distinct + (n_texts > 0)
    per_token = float(np.log10(total + 0.5 * (distinct + 1)))
    words = counts.where("item < 0").select("item", F.log10(F.col("m") + 0.5).alias("worth"), "n")
    worths = staged(byte_worths(counts.where("item >= 0"), n_grams).unionByName(words))
    drop_staged(counts)
    common = [common_worths(worths.where(c)) for c in ("item >= 0", "item < 0")]
    shared = spark.sparkContext.broadcast(common)
    names = [id_col, *also]
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in names)
    end, unseen = float(np.log10(n_texts + 0.5)), float(np.log10(0.5))

    def first_pass(batches):
        of_bytes, of_words = (Worths(*c) for c in shared.value)
        for b in text_slices(batches, "__text", SCORED_BYTES):
            stream, starts, text_words, n = streams(b.column("__text"))
            grams = byte_strings(stream, starts)
            worth, there = of_bytes(grams)
            sizes = np.diff(np.r_[starts, len(stream)])
            score = np.add.reduceat(worth, starts) if len(starts) else np.empty(0)
            ids, vocabulary = word_ids(text_words)
            items = word_items(vocabulary)
            word_worth, is_common = of_words(items)
            doc = np.repeat(np.arange(len(n)), n)
            base = np.bincount(doc, weights=word_worth[ids], minlength=len(n)) + end - (n + 1) * per_token
            known = np.bincount(doc, weights=is_common[ids], minlength=len(n)).astype(np.int64) + (n_texts > 0)
            # What is not common is asked for, each distinct item once; texts name its place among those asked for.
            asked, place = np.unique(grams[~there], return_inverse=True)
            words_asked = items[~is_common]
            place_of = np.cumsum(~is_common) - 1 + len(asked)
            rare = ~is_common[ids]
            of = np.r_[np.repeat(np.arange(len(n)), sizes)[~there], doc[rare]]
            places = np.r_[place, place_of[ids[rare]]].astype(np.int32)[np.argsort(of, kind="stable")]
            rare_of = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(n)))].astype(np.int32)), pa.array(places))
            lookups = np.r_[asked, words_asked]
            ends = np.full(len(n) + 1, len(lookups), np.int32)
            ends[0] = 0  # the batch's first row has the batch's items
            out = [pa.array(n + 1), pa.array(known), pa.array(base), pa.array(score), pa.array([uuid.uuid4().hex] * len(n)), rare_of, pa.ListArray.from_arrays(pa.array(ends), pa.array(lookups))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *out], [*names, "n_tokens", "n_known", "base", "score", "batch", "rare", "lookups"])

    scored = staged(by_bytes(src).mapInArrow(first_pass, f"{kinds}, n_tokens long, n_known long, base double, score double, batch string, rare array<int>, lookups array<long>"))
    asked = scored.where(F.size("lookups") > 0).select(F.col("batch").alias("of"), F.posexplode("lookups").alias("place", "item"))
    answers = asked.join(worths.select("item", "worth"), "item").select("of", "place", F.col("item") < 0, "worth").toDF("of", "place", "word", "worth")

    def add(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        rare = rows["rare"].combine_chunks()
        places, n = rare.flatten().to_numpy(), pc.list_value_length(rare).to_numpy(zero_copy_only=False)
        # A byte string has a worth always; of words only those of training texts have one.
        size = int(places.max()) + 1 if len(places) else 0
        at, word = found["place"].to_numpy(), found["word"].to_numpy()
        worth, is_word, there = np.full(size, unseen), np.ones(size, bool), np.zeros(size, bool)
        worth[at], is_word[at], there[at] = found["worth"].to_numpy(), word, True
        doc = np.repeat(np.arange(len(n)), n)
        each = [np.bincount(doc, weights=w[places], minlength=len(n)) for w in (np.where(is_word, worth, 0), np.where(is_word, 0, worth), is_word & there)]
        out = [rows["n_tokens"], pa.array(rows["n_known"].to_numpy() + each[2].astype(np.int64)), pa.array(np.full(len(n), total, np.int64)), pa.array(rows["base"].to_numpy() + each[0]), pa.array(rows["score"].to_numpy() + each[1])]
        return pa.table([*[rows[c] for c in names], *out], names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return scored.drop("lookups").groupBy("batch").cogroup(answers.groupBy("of")).applyInArrow(add, schema)
