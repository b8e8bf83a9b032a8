r"""Quality rules as a short-circuit cascade.

Each rule rejects texts by features of their words `[^\x20\x09-\x0D]+` and lines. On a bounded sample the
rules' costs and the shares they reject are estimated; then they run in the order of rejection per cost, each
only on what the rules before have left. The verdict does not depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, by_bytes, doc_windows, filled, mix, rolling, split_words, text_slices

#: Bounds of the sample that orders the rules.
SAMPLE_ROWS, SAMPLE_TEXT_BYTES = 1000, 65_536
SYMBOLS = b"#*$%&|<>"
REPEAT_WIDTH = 8


class Texts:
    """A batch of texts with features that are computed when a rule first asks for them."""

    def __init__(self, texts: pa.Array):
        self.texts = filled(texts)
        self.got: dict[str, np.ndarray] = {}
        self.words_of: tuple[np.ndarray, pa.Array, np.ndarray] | None = None

    def __len__(self) -> int:
        return len(self.texts)

    def take(self, keep: np.ndarray) -> Texts:
        out = Texts(self.texts.filter(pa.array(keep)))
        out.got = {k: v[keep] for k, v in self.got.items()}
        if self.words_of:
            ids, vocabulary, counts = self.words_of
            out.words_of = ids[np.repeat(keep, counts)], vocabulary, counts[keep]
        return out

    def copy(self) -> Texts:
        """The same texts, with what has been computed so far."""
        out = Texts(self.texts)
        out.got, out.words_of = dict(self.got), self.words_of
        return out

    def words(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Each word's place among the distinct words, those, and each text's number of words."""
        if not self.words_of:
            words, counts = split_words(self.texts)
            coded = words.dictionary_encode()
            self.words_of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, counts
        return self.words_of

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.got:
            self.got[name] = FEATURES[name](self)
        return self.got[name]

    def per_text(self, hits: np.ndarray) -> np.ndarray:
        """Sums by text of hits, one for each word."""
        counts = self.words()[2]
        return np.bincount(np.repeat(np.arange(len(counts)), counts), weights=hits, minlength=len(counts)).astype(np.int64)


def n_words(t: Texts) -> np.ndarray:
    return t.words()[2]


def word_chars(t: Texts) -> np.ndarray:
    ids, vocabulary, _ = t.words()
    return t.per_text(pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False)[ids])


def n_symbols(t: Texts) -> np.ndarray:
    offsets = np.frombuffer(t.texts.buffers()[1], np.int32)[: len(t) + 1]
    data = np.frombuffer(t.texts.buffers()[2] or b"", np.uint8)
    table = np.zeros(256, np.int64)
    table[list(SYMBOLS)] = 1
    ends = np.r_[0, np.cumsum(table[data[offsets[0] : offsets[-1]]])]
    return np.diff(ends[offsets - offsets[0]])


def n_lines(t: Texts) -> np.ndarray:
    return _lines(t)[0]


def n_dup_lines(t: Texts) -> np.ndarray:
    return _lines(t)[1]


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier one, by text."""
    if "_lines" not in t.got:
        parts = pc.split_pattern(t.texts, "\n")
        per = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        coded = parts.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        worded = pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)).to_numpy(zero_copy_only=False) > 0
        doc = np.repeat(np.arange(len(per)), per)
        keep = worded[code]
        doc, code = doc[keep], code[keep]
        total = np.bincount(doc, minlength=len(per))
        pairs = np.unique(doc * (len(worded) + 1) + code) // (len(worded) + 1)
        t.got["_lines"] = np.stack([total, total - np.bincount(pairs, minlength=len(per))], axis=1)
    return t.got["_lines"][:, 0], t.got["_lines"][:, 1]


def n_repeat_words(t: Texts) -> np.ndarray:
    """Words in windows of REPEAT_WIDTH words that are found twice or more in their text."""
    ids, _, counts = t.words()
    at, doc = doc_windows(counts, REPEAT_WIDTH)
    if not len(at):
        return np.zeros(len(counts), np.int64)
    key = rolling(mix(ids.astype(np.uint64) + np.uint64(1)), REPEAT_WIDTH)[at] ^ mix(doc.astype(np.uint64) + np.uint64(7))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    a, b = at[order[:-1][same]], at[order[1:][same]]
    # Equal hashes are compared word by word; windows of unlike words are told apart exactly.
    if len(a) and not (np.all(doc[order[:-1][same]] == doc[order[1:][same]]) and all(np.array_equal(ids[a + k], ids[b + k]) for k in range(REPEAT_WIDTH))):
        seen: dict[tuple, int] = {}
        found = set()
        for s, d in zip(at.tolist(), doc.tolist()):
            first = seen.setdefault((d, *ids[s : s + REPEAT_WIDTH].tolist()), s)
            if first != s:
                found |= {first, s}
        starts = np.fromiter(sorted(found), np.int64, len(found))
    else:
        starts = np.unique(np.r_[a, b])
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[starts] += 1
    edge[starts + REPEAT_WIDTH] -= 1
    return t.per_text(np.cumsum(edge)[:-1] > 0)


def n_shouted(t: Texts) -> np.ndarray:
    """Words of two or more ASCII capitals and no small ASCII letter."""
    ids, vocabulary, _ = t.words()
    loud = [sum(65 <= c <= 90 for c in w) > 1 and not any(97 <= c <= 122 for c in w) for w in map(str.encode, vocabulary.to_pylist())]
    return t.per_text(np.array(loud, bool)[ids])


def n_marks(t: Texts) -> np.ndarray:
    """Words without any ASCII letter or digit or character beyond ASCII."""
    ids, vocabulary, _ = t.words()
    bare = [not any(c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 for c in w) for w in map(str.encode, vocabulary.to_pylist())]
    return t.per_text(np.array(bare, bool)[ids])


def n_echoes(t: Texts) -> np.ndarray:
    """Words equal to the word before them in their text."""
    ids, _, counts = t.words()
    if not len(ids):
        return np.zeros(len(counts), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    return t.per_text(np.r_[False, (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])])


FEATURES: dict[str, Callable[[Texts], np.ndarray]] = {
    f.__name__: f for f in (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_shouted, n_marks, n_echoes)
}


@dataclass(frozen=True)
class Rule:
    """Rejects the texts for which `rejects` holds."""

    name: str
    rejects: Callable[[Texts], np.ndarray] = field(compare=False)


BASE = (
    Rule("few_words", lambda t: t["n_words"] < 20),
    Rule("repeats", lambda t: 100 * t["n_repeat_words"] > 30 * t["n_words"]),
)
RULES = (
    *BASE,
    Rule("symbols", lambda t: 10 * t["n_symbols"] > t["n_words"]),
    Rule("duplicate_lines", lambda t: 2 * t["n_dup_lines"] > t["n_lines"]),
    Rule("word_length", lambda t: (t["word_chars"] < 2 * t["n_words"]) | (t["word_chars"] > 15 * t["n_words"])),
    Rule("shouting", lambda t: 100 * t["n_shouted"] > 30 * t["n_words"]),
    Rule("echoes", lambda t: 100 * t["n_echoes"] > 30 * t["n_words"]),
    Rule("marks", lambda t: 100 * t["n_marks"] > 20 * t["n_words"]),
)


def order_rules(rules: tuple[Rule, ...], sample: pa.Array, paid: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """Rules by rejection per cost on the sample: each time the greatest of those that are left, on the texts that the
    rules before have left. What has been computed for a rule before, or is named in `paid`, costs nothing more."""
    texts, left, out = Texts(sample), list(rules), []
    for feature in paid:
        texts[feature]
    while left and len(texts):
        worth = {}
        for rule in left:
            trial, began = texts.copy(), time.thread_time()
            share = float(np.mean(rule.rejects(trial)))
            worth[rule.name] = share / max(time.thread_time() - began, 1e-6)
        best = min(left, key=lambda r: (-worth[r.name], r.name))
        out.append(best)
        left.remove(best)
        texts = texts.take(~best.rejects(texts))
    return (*out, *left)


def cascade(texts: Texts, rules: tuple[Rule, ...]) -> list[str | None]:
    """The name of the first rule that rejects each text, or None."""
    failed: list[str | None] = [None] * len(texts)
    alive = np.arange(len(texts))
    for rule in rules:
        if not len(alive):
            break
        out = rule.rejects(texts)
        for i in alive[out]:
            failed[i] = rule.name
        if out.any():
            texts, alive = texts.take(~out), alive[~out]
    return failed


def ordered_for(docs: DataFrame, text_col: str, rules: tuple[Rule, ...], paid: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """The rules in the order that a bounded sample of docs suggests, where the features in `paid` are there already."""
    src = docs.select(docs[text_col].alias("text")).where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    rows = src.sample(min(1.0, 4 * SAMPLE_ROWS / max(docs.count(), 1)), seed=1).limit(SAMPLE_ROWS).collect()
    held, size = [], 0
    for r in rows:
        size += len(r["text"])
        if size > SLICE_BYTES:
            break
        held.append(r["text"])
    return order_rules(rules, pa.array(held, pa.string()), paid)


def quality_report(docs: DataFrame, features: tuple[str, ...] = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The named features of every whole text, base_failed (a BASE rule rejects it), failed_rule (the first of
    the cascade that does, null if none; its name depends on the order) and kept.

    Null and empty texts have no words and fail. Repeated rows and null ids give rows of their own. Other
    columns are not read. No shuffle.
    """
    ordered = ordered_for(docs, text_col, rules, features)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches):
        for b in text_slices(batches, "text"):
            t = Texts(b.column("text"))
            found = [pa.array(t[f].astype(np.int64)) for f in features]
            base = np.logical_or.reduce([r.rejects(t) for r in BASE])
            failed = cascade(t, ordered)
            kept = np.array([f is None for f in failed], bool)
            yield pa.RecordBatch.from_arrays([b.column("id"), *found, pa.array(base), pa.array(failed, pa.string()), pa.array(kept)], [id_col, *features, "base_failed", "failed_rule", "kept"])

    fields = ", ".join(f"{f} long" for f in features)
    return by_bytes(src).mapInArrow(run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, {fields}, base_failed boolean, failed_rule string, kept boolean")


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose texts no rule rejects. Cases as in quality_report."""
    ordered = ordered_for(docs, text_col, rules)
    at = docs.columns.index(text_col)
    names = [f"c{k}" for k in range(len(docs.columns))]

    def run(batches):
        for b in text_slices(batches, names[at]):
            yield b.filter(pa.array([f is None for f in cascade(Texts(b.column(at)), ordered)], pa.bool_()))

    src = docs.toDF(*names)
    return by_bytes(src).mapInArrow(run, src.schema).toDF(*docs.columns)
