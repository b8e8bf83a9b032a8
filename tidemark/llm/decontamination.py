r"""Benchmark decontamination by an FM-index of each shard of the training texts.

Texts are lower-cased (A-Z) and cut into words of digits, ASCII letters and characters beyond ASCII. A word
that no benchmark item has cannot be in an occurrence of a phrase, so a shard is indexed, once, as its runs of
benchmark words that are long enough, each closed by a separator. What is kept of it are the BWT, as a wavelet tree of
bits with ranks, and sampled suffix positions. A block's phrases are searched backward at once, occurrences are located
by the sampled positions, and their words merge into spans. Phrases are in the shared folder, in blocks of a bounded size whatever
the benchmark's. A shard opens a block only if it has the rarest word of one of its windows, and a worker keeps the
blocks that it used last.
"""

from __future__ import annotations

import pickle
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, filled, ragged, shared_dir, text_slices
from .files import local_path, open_output

#: UTF-8 bytes of benchmark text in a block of phrases (a longer item is a block of its own).
BLOCK_BYTES = 1 << 20
#: One of so many suffix positions is kept, and each run's first.
SAMPLED = 16
#: Bytes of blocks' files that a worker holds.
HELD_BYTES = 64 << 20
#: The ending of the name of a block's file of words.
WORDS = "-words"

_LOWER = np.full(256, 32, np.uint8)
_LOWER[48:58] = np.arange(48, 58)
_LOWER[97:123] = np.arange(97, 123)
_LOWER[65:91] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)


def plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    r"""Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased texts, and each text's number of them."""
    from .common import split_words

    texts = filled(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return split_words(pa.StringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(_LOWER[data].tobytes())))


class Phrases:
    """A block's distinct windows of words, and the items that have them."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        words, counts = plain_words(pa.array([t for _, t in items], pa.string()))
        coded = words.dictionary_encode()
        self.vocabulary = coded.dictionary
        ids = coded.indices.to_pylist()
        found: dict[tuple[int, ...], set[int]] = {}
        at = 0
        for k, n in enumerate(counts.tolist()):
            for s in range(max(n - width + 1, min(n, 1))):
                found.setdefault(tuple(ids[at + s : at + min(s + width, n)]), set()).add(k)
            at += n
        windows = list(found)
        self.items = [i for i, _ in items]
        self.size = np.array([len(w) for w in windows], np.int64)
        #: Words from the last to the first, one row for each place; 0 is past the window's start.
        self.back = np.zeros((max(self.size, default=0), len(windows)), np.int64)
        for k, w in enumerate(windows):
            self.back[: len(w), k] = np.array(w[::-1]) + 1
        owners = [sorted(found[w]) for w in windows]
        self.n_items = np.array([len(o) for o in owners], np.int64)
        self.first_item = np.cumsum(self.n_items) - self.n_items
        self.item = np.array([i for o in owners for i in o], np.int64)

    def rarest(self) -> pa.Array:
        """Of each window the word that the fewest windows of the block have."""
        if not len(self.size):
            return self.vocabulary.slice(0, 0)
        times = np.bincount(self.back.ravel(), minlength=len(self.vocabulary) + 1)
        times[0] = np.iinfo(times.dtype).max
        return self.vocabulary.take(pa.array(np.unique(self.back[times[self.back].argmin(axis=0), np.arange(len(self.size))]) - 1))


#: Each bit of a word, and those lower than it.
BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
LOWER_BITS = BIT - np.uint64(1)


class Bits:
    """A sequence of bits with ranks: 64 of them to a word, and the ones before each word."""

    def __init__(self, ones: np.ndarray):
        packed = np.packbits(ones, bitorder="little")
        self.words = np.zeros(len(ones) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        in_word = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(in_word, dtype=np.int32) - in_word
        self.zeros = len(ones) - int(in_word.sum())

    def __getitem__(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] & BIT[place & 63]) > 0

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = place >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & LOWER_BITS[place & 63])


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from the highest bit, with zeros moved to the front."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[Bits] = []
        for shift in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            one = (symbols >> shift & 1).astype(bool)
            self.levels.append(Bits(one))
            symbols = np.r_[symbols[~one], symbols[one]]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        low = np.zeros_like(place)
        for shift, bits in zip(range(len(self.levels) - 1, -1, -1), self.levels):
            one = (symbol >> shift & 1).astype(bool)
            low, place = (np.where(one, bits.zeros + r, x - r) for x, r in ((low, bits.rank(low)), (place, bits.rank(place))))
        return place - low

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before that."""
        low, symbol = np.zeros_like(place), np.zeros_like(place)
        for bits in self.levels:
            one = bits[place]
            symbol = symbol << 1 | one
            low, place = (np.where(one, bits.zeros + r, x - r) for x, r in ((low, bits.rank(low)), (place, bits.rank(place))))
        return symbol, place - low


class FMIndex:
    """Of runs of symbols from 1 up, each of at least one, given joined with their lengths."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, n_symbols: int):
        n_runs, n = len(sizes), len(symbols) + len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(n, np.int64)
        text[np.setdiff1d(np.arange(n), ends, assume_unique=True)] = symbols
        # Separators are told apart by their order, so no comparison goes beyond one.
        rank = text + n_runs
        rank[ends] = np.arange(n_runs)
        step = 1
        while True:
            key = rank * (n + n_symbols + 1) + np.r_[rank[step:] + 1, np.zeros(min(step, n), np.int64)]
            order = np.argsort(key, kind="stable")
            fresh = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                break
            step *= 2
        self.size = n
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols))]
        self.tree = WaveletTree(text[order - 1], n_symbols)
        start = np.zeros(n, bool)
        start[np.r_[0, ends[:-1] + 1]] = True
        #: Rows whose suffix positions are kept, and those positions.
        kept = (order % SAMPLED == 0) | start[order]
        self.sampled, self.position = Bits(kept), order[kept].astype(np.int32)
        self.ends = ends

    def search(self, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) of each pattern, given its symbols from the last to the first and then zeros."""
        low, high = np.zeros(back.shape[1], np.int64), np.full(back.shape[1], self.size)
        alive = np.arange(back.shape[1])
        for row in back:
            alive = alive[(row[alive] > 0) & (low[alive] < high[alive])]
            if not len(alive):
                break
            c = row[alive]
            low[alive] = self.before[c] + self.tree.rank(c, low[alive])
            high[alive] = self.before[c] + self.tree.rank(c, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places, in the joined symbols, at which the rows' suffixes start."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        going = np.flatnonzero(~self.sampled[rows])
        while len(going):
            c, times = self.tree.at(rows[going])
            rows[going] = self.before[c] + times
            steps[going] += 1
            going = going[~self.sampled[rows[going]]]
        at = self.position[self.sampled.rank(rows)] + steps
        return at - np.searchsorted(self.ends, at)  # in the joined symbols: without the separators before


class Shard:
    """An FM-index of texts, given as their joined words and numbers of words, for blocks of phrases."""

    def __init__(self, words: pa.Array, counts: np.ndarray, blocks: list[str]):
        coded = words.dictionary_encode()
        known, shortest = np.zeros(len(coded.dictionary), bool), None
        self.blocks = blocks
        for block in blocks:
            vocabulary, _, least = load(block + WORDS)
            if least is not None:
                known |= pc.is_in(coded.dictionary, value_set=vocabulary).to_numpy(zero_copy_only=False)
                shortest = least if shortest is None else min(shortest, least)
        self.vocabulary = coded.dictionary.filter(pa.array(known))
        code = np.where(known, np.cumsum(known), 0)[coded.indices.to_numpy(zero_copy_only=False)]
        doc = np.repeat(np.arange(len(counts)), counts)
        there = code > 0
        head = there & np.r_[True, ~there[:-1] | (doc[1:] != doc[:-1])][: len(there)]
        run = np.cumsum(head)[there] - 1
        sizes = np.bincount(run, minlength=1)
        long = sizes >= (shortest or 1)
        self.places = np.flatnonzero(there)[long[run]]
        self.index = FMIndex(code[self.places], sizes[long], len(self.vocabulary) + 1) if len(self.places) else None
        self.symbols = np.unique(code[self.places])

    def to_open(self) -> Iterator[Phrases]:
        """The blocks of which a window can occur: those with a window whose rarest word is indexed."""
        if self.index is not None:
            indexed = self.vocabulary.take(pa.array(self.symbols - 1))
            for block in self.blocks:
                if pc.any(pc.is_in(load(block + WORDS)[1], value_set=indexed)).as_py():
                    yield load(block)

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Places, among the words of all texts, at which windows occur; and those windows."""
        code = pc.index_in(phrases.vocabulary, value_set=self.vocabulary)
        code = np.r_[0, pc.fill_null(code, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1]
        back = code[phrases.back]
        # A window with a word that the texts do not have is not looked for.
        whole = np.flatnonzero(((back > 0) == (phrases.back > 0)).all(axis=0))
        low, high = self.index.search(back[:, whole])
        times = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(times)), times)
        return self.places[self.index.locate(low[window] + ragged(times))], whole[window]


def write_phrases(benchmark: DataFrame, width: int, item_col: str, text_col: str) -> list[str]:
    """Blocks of phrases as files in the shared folder, made by the tasks that read the table; their names. Beside each
    is a file of its words, each window's rarest, and the length of the shortest window."""
    uri = shared_dir(benchmark.sparkSession)
    rows = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("i"), benchmark[text_col].alias("t")).where("t is not null")

    def run(batches):
        for b in text_slices(batches, "t", BLOCK_BYTES):
            name = f"{uri}/phrases-{uuid.uuid4().hex}"
            phrases = Phrases(list(zip(*(c.to_pylist() for c in b.columns))), width)
            for end, kept in (("", phrases), (WORDS, (phrases.vocabulary, phrases.rarest(), min(phrases.size.tolist(), default=None)))):
                with open_output(name + end) as f:
                    f.write(pickle.dumps(kept))
            yield pa.RecordBatch.from_pydict({"name": [name]})

    return [r["name"] for r in by_bytes(rows).mapInArrow(run, "name string").collect()]


_HELD: OrderedDict[str, tuple[object, int]] = OrderedDict()


def load(uri: str) -> Phrases | tuple[pa.Array, pa.Array, int | None]:
    """A block's file, or that of its words. A worker holds those it used last, up to HELD_BYTES of them."""
    if uri in _HELD:
        _HELD.move_to_end(uri)
        return _HELD[uri][0]
    if (path := local_path(uri)) is not None:
        with open(path, "rb") as f:
            data = f.read()
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as f:
            data = f.read()
    _HELD[uri] = pickle.loads(data), len(data)
    while len(_HELD) > 1 and sum(n for _, n in _HELD.values()) > HELD_BYTES:
        _HELD.popitem(last=False)
    return _HELD[uri][0]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs, all columns, with n_words, n_hit (words in an occurrence of a window), item_ids (strings, sorted:
    the items with occurring windows), spans (hit words, merged, as [from, to)) and contaminated (n_hit > 0
    and 20 * n_hit >= n_words).

    A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window.
    Null and empty texts have no words and no hits, and neither table need have rows. Null item ids count as
    the empty string. Repeated rows give rows of their own. The new columns follow those of docs, whatever
    the names. No shuffle.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    src = docs.toDF(*names)
    blocks = write_phrases(benchmark, width, item_col, item_text_col)

    def run(batches):
        for b in text_slices(batches, names[at]):
            words, counts = plain_words(b.column(at))
            n, first = int(counts.sum()), np.cumsum(counts) - counts
            doc = np.repeat(np.arange(len(counts)), counts)
            edge = np.zeros(n + 1, np.int64)
            items: dict[int, set[str]] = {}
            shard = Shard(words, counts, blocks)
            for phrases in shard.to_open():
                place, window = shard.occurrences(phrases)
                np.add.at(edge, place, 1)
                np.add.at(edge, place + phrases.size[window], -1)
                pairs = np.unique(doc[place] * max(len(phrases.size), 1) + window)
                d, w = pairs // max(len(phrases.size), 1), pairs % max(len(phrases.size), 1)
                each = phrases.n_items[w]
                for i, k in zip(np.repeat(d, each).tolist(), phrases.item[np.repeat(phrases.first_item[w], each) + ragged(each)].tolist()):
                    items.setdefault(i, set()).add(phrases.items[k])
            hit = np.cumsum(edge)[:-1] > 0
            n_hit = np.bincount(doc[hit], minlength=len(counts)).astype(np.int64)
            spans = [[] for _ in range(len(counts))]
            for i in np.flatnonzero(n_hit).tolist():
                flags = np.r_[False, hit[first[i] : first[i] + counts[i]], False]
                edges = np.flatnonzero(flags[1:] != flags[:-1]).tolist()
                spans[i] = [{"from": a, "to": z} for a, z in zip(edges[::2], edges[1::2])]
            found = [sorted(items.get(i, ())) for i in range(len(counts))]
            out = [pa.array(counts), pa.array(n_hit), pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array((n_hit > 0) & (20 * n_hit >= counts))]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*names, "n_words", "n_hit", "item_ids", "spans", "contaminated"])

    kinds = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in names)
    out = by_bytes(src).mapInArrow(run, f"{kinds}, n_words long, n_hit long, item_ids array<string>, spans array<struct<from:int,to:int>>, contaminated boolean")
    return out.toDF(*docs.columns, "n_words", "n_hit", "item_ids", "spans", "contaminated")
