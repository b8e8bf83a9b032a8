"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. Parsing another text greedily into longest
phrases that occur in that text counts phrases; the language whose normalised count (phrases times the log of
its labelled text's length) is least wins. Texts are parsed whole, yet in blocks of BLOCK characters, all blocks of a
batch in step: first as if a phrase began at each block, then again from the state in which the block before ends,
until the parse meets the one that is there already, which it mostly does within a phrase or two.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Worths, by_bytes, drop_staged, filled, ragged, staged, text_slices

#: Bounds of the labelled sample: at most so many texts per language and so many characters of each.
SAMPLE_TEXTS, SAMPLE_TEXT_CHARS = 400, 20_000
#: Characters of labelled text that a language's automaton holds at most, and those of all languages together.
MODEL_CHARS, ALL_CHARS = 32_000, 4_000_000
#: Cells (4 bytes each) of a language's table of states by letters; a larger one is a hash table of the moves there are.
TABLE_CELLS = 8_000_000
#: Languages whose shares are broadcast at most; more are joined by a shuffle.
BROADCAST_LANGUAGES = 100_000
BLOCK = 128
#: Symbols: PAD is none, GAP is a run of anything but letters, FOREIGN a letter that other languages have, and the
#: language's own letters follow.
PAD, GAP, FOREIGN, OWN = 0, 1, 2, 3


@lru_cache(1)
def lowered() -> np.ndarray:
    """By code point: the lower-case letter's code point, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            table[c] = ord(x.lower()[0])
    return table


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with each run of anything else as one 0, and each text's length."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = lowered()[points]
    doc = np.repeat(np.arange(len(texts)), sizes)
    if not len(low):
        return low, sizes
    keep = (low > 0) | np.r_[True, (low[:-1] > 0) | (doc[1:] != doc[:-1])]
    return low[keep], np.bincount(doc[keep], minlength=len(texts)).astype(np.int64)


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of a sequence's suffix automaton; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


class Moves:
    """A language's automaton for many states in step. States are numbers; no move is -1."""

    def __init__(self, low: np.ndarray):
        self.letters = np.unique(low[low > 0])
        go = automaton(self.symbols(low, np.zeros(0, bool)).tolist())
        self.width = OWN + len(self.letters)
        root = np.zeros(self.width, np.int32)
        root[list(go[0])] = list(go[0].values())
        root[PAD] = 0
        self.root, self.table = root, None
        if len(go) * self.width <= TABLE_CELLS:
            self.table = np.full((len(go), self.width), -1, np.int32)
            for s, moves in enumerate(go):
                self.table[s, list(moves)] = list(moves.values())
            self.table[:, PAD] = np.arange(len(go))
            self.table = self.table.ravel()
        else:
            pairs = [(s * self.width + c, to) for s, moves in enumerate(go) for c, to in moves.items()]
            self.found = Worths(np.array([p for p, _ in pairs], np.int64), np.array([to for _, to in pairs], np.float64))

    def symbols(self, low: np.ndarray, foreign: np.ndarray) -> np.ndarray:
        """Of lower-case letters (0 for a gap): the language's symbols; letters of no language are PAD."""
        at = np.minimum(np.searchsorted(self.letters, low), max(len(self.letters) - 1, 0))
        own = self.letters[at] == low if len(self.letters) else np.zeros(len(low), bool)
        other = np.where(foreign, FOREIGN, PAD) if len(foreign) else PAD
        return np.where(low == 0, GAP, np.where(own, at + OWN, other)).astype(np.int32)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase ended before the symbol."""
        if self.table is not None:
            to = self.table[state * self.width + symbol]
        else:
            worth, known = self.found(state.astype(np.int64) * self.width + symbol)
            to = np.where(symbol == PAD, state, np.where(known, worth, -1)).astype(np.int32)
        missed = to < 0
        return np.where(missed, self.root[symbol], to), missed


class CrossParser:
    """Automata of labelled text, one for each language."""

    def __init__(self, samples: dict[str, list[str]]):
        most = min(MODEL_CHARS, max(1, ALL_CHARS // max(len(samples), 1)))
        text = {lang: letters(texts)[0][:most] for lang, texts in sorted(samples.items())}
        self.languages = list(text)
        joined = np.concatenate([*text.values(), np.empty(0, np.int32)])
        self.known = np.unique(joined[joined > 0])
        self.moves = [Moves(t) for t in text.values()]
        self.scale = [float(np.log2(len(t) + 2)) for t in text.values()]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases by text and language, and which texts have a letter."""
        low, sizes = letters(texts)
        doc = np.repeat(np.arange(len(texts)), sizes)
        lettered = np.bincount(doc[low > 0], minlength=len(texts)) > 0
        n_blocks = -(-sizes // BLOCK)
        first = np.cumsum(n_blocks) - n_blocks
        place = ragged(sizes)
        row, column = place % BLOCK, first[doc] + place // BLOCK
        known = np.isin(low, self.known)
        # A letter that no language has is a phrase of its own in all of them, and is passed over in the parse.
        alone = np.bincount(doc[(low > 0) & ~known], minlength=len(texts))
        block_doc = np.repeat(np.arange(len(texts)), n_blocks)
        follows = np.r_[block_doc[1:] == block_doc[:-1], np.zeros(min(len(block_doc), 1), bool)]
        out = np.empty((len(texts), len(self.languages)))
        for k, moves in enumerate(self.moves):
            grid = np.zeros((BLOCK, int(n_blocks.sum())), np.int32)
            grid[row, column] = moves.symbols(low, known)
            missed = parsed(moves, grid, follows)
            # Each phrase but a text's last one ends where the next begins.
            out[:, k] = (np.bincount(block_doc, weights=missed, minlength=len(texts)) + (sizes > 0) + alone) * self.scale[k]
        return out, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits, lettered = self.phrases(texts)
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(-np.minimum((bits - bits.min(axis=1, keepdims=True)) / np.array(self.scale), 60)).sum(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0)


def parsed(moves: Moves, grid: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Phrases that end within each column of grid, where a column is parsed on from the one before if that follows."""
    states, ends = np.empty(grid.shape, np.int32), np.empty(grid.shape, bool)
    state = np.zeros(grid.shape[1], np.int32)
    for row, symbol in enumerate(grid):
        state, ends[row] = moves(state, symbol)
        states[row] = state
    # Columns whose first state is another than they were parsed from.
    before = np.flatnonzero(follows)
    again = before[states[-1, before] != 0] + 1 if len(grid) else before
    state = states[-1, again - 1]
    while len(again):
        last, left, now = states[-1, again].copy(), np.arange(len(again)), state
        for row in range(len(grid)):
            at = again[left]
            now, ends[row, at] = moves(now, grid[row, at])
            apart = states[row, at] != now
            states[row, at] = now
            left, now = left[apart], now[apart]
            if not len(left):
                break
        changed = again[left][follows[again[left]] & (states[-1, again[left]] != last[left])]
        again, state = changed + 1, states[-1, changed]
    return ends.sum(axis=0)


def labelled_sample(train: DataFrame, lang_col: str, text_col: str) -> dict[str, list[str]]:
    """Texts by language, at most SAMPLE_TEXTS each: those with the least hashes. Exact copies count once. Of a text
    of more than SAMPLE_TEXT_CHARS there is a piece of as many, from its first letter on: every language with a
    labelled text has a sample."""
    src = train.select(train[lang_col].alias("lang"), train[text_col].alias("text")).where("lang is not null and text is not null")
    keyed = src.withColumn("key", F.xxhash64("text"))
    # Copies are one key before any is left out. Of many keys only about 4 * SAMPLE_TEXTS with the least hashes meet, of
    # up to as many all: with less than one chance in 10**100 are they fewer than SAMPLE_TEXTS.
    low = F.pmod("key", F.lit(1 << 40))
    keys = staged(keyed.select("lang", "key").distinct())
    share = keys.groupBy("lang").agg(F.least(F.lit(1.0), 4 * SAMPLE_TEXTS / F.count("*")).alias("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(low, "key"))
    share = staged(share)
    few = keys.join(F.broadcast(share) if share.count() <= BROADCAST_LANGUAGES else share, "lang").where(low <= F.col("share") * float(1 << 40))
    least = few.select("lang", "key").withColumn("k", rank).where(F.col("k") <= SAMPLE_TEXTS)
    piece = F.when(F.length("text") > SAMPLE_TEXT_CHARS, F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, SAMPLE_TEXT_CHARS)).otherwise(F.col("text"))
    chosen = keyed.join(F.broadcast(least), ["lang", "key"]).select("lang", "k", piece.alias("text")).distinct()
    out: dict[str, list[str]] = {}
    for r in chosen.orderBy("lang", "k", "text").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    drop_staged(keys)
    drop_staged(share)
    return out


def identify_language(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", also: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred and score (0 to 1) for every whole text, learnt from the labelled rows of `train`.

    Null texts and texts without a letter are `und` with score 0, as is all if train has no labelled text.
    Equal counts go to the language that sorts first. Repeated rows and null ids give rows of their own.
    Only id_col, text_col and the columns named in `also`, which are passed on, are read. No shuffle of texts.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(CrossParser(labelled_sample(train, lang_col, text_col)))
    src = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("__text"), *[docs[c] for c in also])
    names = [id_col, *also]
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for b in text_slices(batches, "__text"):
            texts = filled(b.column("__text")).to_pylist()
            lang, score = model.value.predict(texts)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return by_bytes(src).mapInArrow(run, f"{kinds}, lang_pred string, score double")
