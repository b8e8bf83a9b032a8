"""Byte-level BPE ids of whole texts, by the tokenizers library on distinct pieces.

A byte-level BPE with the usual split pattern never joins anything across a single space that stands
before a visible character, so a text is cut there and each distinct piece is encoded once. Texts in
which a space stands before other white space are encoded whole. The ids are those of the whole text.
"""

from __future__ import annotations

import os
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import filled, ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct pieces that one worker remembers; later ones are encoded again in each batch.
REMEMBERED = 150_000
#: UTF-8 bytes of text that are encoded at once: each distinct run in them is looked up once.
ENCODED_BYTES = 4 << 20
#: Longer ones are not remembered.
LONGEST = 128

# Bytes that may begin white space after a space: ASCII, and the lead bytes of all other white space.
_SPACE_LEAD = np.zeros(256, bool)
_SPACE_LEAD[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces without the space in front, the number of pieces of each text, and which texts stay whole."""
    texts = filled(texts)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[: n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    odd_at = np.flatnonzero((data[:-1] == 32) & _SPACE_LEAD[data[1:]]) + offsets[0] if len(data) else np.empty(0, int)
    whole = np.zeros(n, bool)
    whole[np.searchsorted(offsets, odd_at, side="right") - 1] = True
    parts = pc.split_pattern(texts, " ")
    return parts, pc.list_value_length(parts).to_numpy(zero_copy_only=False), whole


class Pieces:
    """Runs of numbers for strings, remembered: value(units) gives a list of numpy arrays."""

    def __init__(self, value):
        self.value, self.rows = value, {}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.sizes = array("q"), array("q")

    def _add(self, arrays: list[np.ndarray]) -> None:
        joined = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
        if self.used + len(joined) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(self.flat), 2 * len(joined)), np.int32)])
        self.flat[self.used : self.used + len(joined)] = joined
        sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
        self.starts.frombytes((np.cumsum(sizes) - sizes + self.used).tobytes())
        self.sizes.frombytes(sizes.tobytes())
        self.used += len(joined)

    def __call__(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each unit's numbers start in the third array, and how many they are."""
        rows = np.fromiter(map(self.rows.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(rows < 0).tolist()
        # Those to remember come first, so that the others can be forgotten by cutting the store.
        short = [i for i in missing if len(units[i]) <= LONGEST][: max(REMEMBERED - len(self.rows), 0)]
        kept = set(short)
        missing = short + [i for i in missing if i not in kept]
        first = len(self.starts)
        self._add(self.value([units[i] for i in missing]))
        rows[missing] = first + np.arange(len(missing))
        starts, sizes = np.array(self.starts)[rows], np.array(self.sizes)[rows]
        flat = self.flat
        self.rows.update(zip([units[i] for i in short], range(first, first + len(short))))
        if len(short) < len(missing):
            end = first + len(short)
            used = self.starts[end]
            del self.starts[end:], self.sizes[end:]
            self.flat, self.used = flat[:used].copy() if used * 2 < len(flat) else flat.copy(), used
        return starts, sizes, flat


# A run of common Latin letters before an ASCII character that is no letter: the split pattern always parts them.
_LETTERS = r"(?s)^(?P<run>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<rest>[\x00-\x40\x5B-\x60\x7B-\x7F].*)$"


def texts_to_runs(texts: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All texts' numbers joined, and each text's number of them."""
    parts, n_parts, whole = cut(texts)
    n = len(n_parts)
    doc = np.repeat(np.arange(n), n_parts)
    flat = parts.flatten()
    inner = ragged(n_parts) > 0
    if whole.any():
        keep = ~whole[doc]
        flat, doc, inner = flat.filter(pa.array(keep)), doc[keep], inner[keep]
    coded = flat.dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    # Each piece is a letter run and a rest, or one run; each distinct one is looked up once.
    split = pc.extract_regex(words, _LETTERS)
    runs = pc.coalesce(pc.struct_field(split, "run"), words).dictionary_encode()
    rests = pc.fill_null(pc.struct_field(split, "rest"), "").dictionary_encode()
    run_of, rest_of = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (runs, rests))
    names, ends = runs.dictionary.to_pylist(), rests.dictionary.to_pylist()
    # A run after a space and the same run at a text's start are two units.
    run = run_of[code]
    heads = np.unique(run[~inner])
    head_at = np.full(len(names), -1, np.int64)
    head_at[heads] = len(names) + np.arange(len(heads))
    units = [" " + w for w in names] + [names[i] for i in heads] + ends
    unit = np.empty(2 * len(code), np.int64)
    unit[::2] = np.where(inner, run, head_at[run])
    unit[1::2] = len(names) + len(heads) + rest_of[code]
    doc = np.repeat(doc, 2)
    odd = np.flatnonzero(whole)
    if len(odd):
        unit = np.concatenate([unit, len(units) + np.arange(len(odd))])
        doc = np.concatenate([doc, odd])
        units += texts.take(pa.array(odd)).to_pylist()
        order = np.argsort(doc, kind="stable")
        unit, doc = unit[order], doc[order]
    starts, sizes, store = pieces(units)
    each = sizes[unit]
    at = np.repeat(starts[unit] - (np.cumsum(each) - each), each)
    at += np.arange(len(at))
    return store[at], np.bincount(doc, weights=each, minlength=n).astype(np.int64)


_ENCODERS: dict[str, Pieces] = {}


def encoder(path: str) -> Pieces:
    """A worker's encoder for a tokenizers .json file: no added special tokens, no truncation, no padding."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        special = [(i, t) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.normalized or t.single_word)]

        def value(units: list[str]) -> list[np.ndarray]:
            """Ids of each unit. Units are joined by a special token, which nothing is merged across."""
            out: list[np.ndarray] = [np.empty(0, np.int32)] * len(units)
            alone = [k for k, u in enumerate(units) if not special or len(u) > 256 or special[0][1].content in u]
            for k in alone:
                out[k] = np.array(tokenizer.encode_batch_fast([units[k]], add_special_tokens=False)[0].ids, np.int32)
            rest = sorted(set(range(len(units))).difference(alone)) if alone else range(len(units))
            for k in range(0, len(rest), 512):
                some = rest[k : k + 512]
                joined = special[0][1].content.join(units[i] for i in some)
                ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
                bounds = [-1, *np.flatnonzero(ids == special[0][0]).tolist(), len(ids)]
                for i, a, z in zip(some, bounds, bounds[1:]):
                    out[i] = ids[a + 1 : z]
            return out

        _ENCODERS[path] = Pieces(value)
    return _ENCODERS[path]


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts (null: none), joined, and each text's number of ids."""
    return texts_to_runs(texts, encoder(path))
