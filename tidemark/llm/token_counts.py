"""Token counts by rank-synchronous array merging.

Pre-tokens are held as ragged numpy arrays of symbols; in each round every pre-token applies its own
lowest-ranked pair, at all places at once, until none has a pair left. The symbols that survive are the
tokens. Distinct pre-tokens are merged once per batch and remembered by each worker.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import by_bytes, text_slices
from .tokenization import ENCODED_BYTES, Pieces, texts_to_runs

# Fixed values of byte-level BPE: the split pattern, and the visible stand-ins of the 256 bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_symbols() -> dict[int, str]:
    """Each byte's character in a byte-level vocabulary."""
    hidden = [b for b in range(256) if b not in set(VISIBLE)]
    return {b: chr(b) for b in VISIBLE} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merger:
    """Merges of one byte-level BPE vocabulary file (tokenizers .json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.first = np.array([vocab[c] for _, c in sorted(byte_symbols().items())], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.none = np.int64(len(keys))
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

    def counts(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        encoded = [p.encode() for p in pretokens]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        symbols = self.first[np.frombuffer(b"".join(encoded), np.uint8)]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        result = sizes.copy()
        while len(symbols) > 1:
            joined = owner[:-1] == owner[1:]
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(joined & (self.keys[at] == key), self.rank[at], self.none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, self.none], first)
            going = lowest < self.none
            per = np.diff(np.r_[first, len(owner)])
            chosen = np.flatnonzero((rank == np.repeat(lowest, per)[:-1]) & (rank < self.none))
            if not len(chosen):
                break
            # In a run of overlapping places (x x x), the first, third, ... are merged.
            head = np.r_[True, np.diff(chosen) > 1]
            run = np.maximum.accumulate(np.where(head, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - run) % 2 == 0]
            symbols[chosen] = self.made[at[chosen]]
            keep = np.repeat(going, per)
            keep[chosen + 1] = False
            result -= np.bincount(owner[chosen], minlength=len(result))
            symbols, owner = symbols[keep], owner[keep]
        return result

    def unit_counts(self, units: list[str]) -> list[np.ndarray]:
        """Tokens of each string; a special string inside counts as one token and splits the text."""
        pretokens: dict[str, int] = {}
        place: list[int] = []
        owner: list[int] = []
        total = np.zeros(len(units), np.int64)
        for i, unit in enumerate(units):
            parts = [unit]
            if any(s in unit for s in self.special):
                parts = self.split.split(unit)
                total[i] += len(parts) - 1
            for part in parts:
                for p in self.pattern.findall(part):
                    place.append(pretokens.setdefault(p, len(pretokens)))
                    owner.append(i)
        if place:
            total += np.bincount(owner, weights=self.counts(list(pretokens))[place], minlength=len(units)).astype(np.int64)
        return [np.array([t], np.int32) for t in total]


_COUNTERS: dict[str, Pieces] = {}


def text_counts(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each whole text (null: none)."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Pieces(Merger(path).unit_counts)
    parts, n_parts = texts_to_runs(texts, _COUNTERS[path])
    ends = np.r_[0, np.cumsum(parts, dtype=np.int64)]
    last = np.cumsum(n_parts)
    return ends[last] - ends[last - n_parts]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text, one row per input row.

    tokenizer: a byte-level BPE .json file that every executor can read. Null and empty texts have 0
    bytes and 0 tokens. Repeated rows and null ids give rows of their own; other columns are not read,
    so their names cannot clash. No shuffle: each text is counted where it is read.
    """
    src = docs.select(docs[id_col], docs[text_col])
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in text_slices(batches, text_col, ENCODED_BYTES):
            n_bytes = pc.fill_null(pc.binary_length(b.column(1).cast(pa.string())), 0).cast(pa.int64())
            n = text_counts(b.column(1), tokenizer)
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return by_bytes(src).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
