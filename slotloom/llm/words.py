"""Words of whole texts without an object per word: places and 64-bit hashes by array operations.

A hash is a polynomial of the word's bytes, read off running sums over the text, so its cost does not
depend on how the bytes form words.  Words of over ``LONG`` bytes are hashed by xxh3 instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from slotloom.llm.shared import mix64

#: Bytes from which a word is hashed apart, and bytes that are worked on at once.
LONG = 128
_STRETCH = 1 << 19
_BASE = 0x9E3779B97F4A7C15


def _powers(x: int) -> np.ndarray:
    found = np.full(_STRETCH + 1, x, np.uint64)
    found[0] = 1
    return np.cumprod(found)


_POWERS, _INVERSES = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_FOLDED = _VALUES[_LOWER]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def hash_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes, never 0, of ascending spans of bytes that do not overlap; with ``fold``, A-Z count as a-z."""
    out = np.empty(len(begins), np.uint64)
    values = _FOLDED if fold else _VALUES
    short = np.flatnonzero(ends - begins <= LONG)
    a = 0
    while a < len(short):
        low = int(begins[short[a]])
        b = int(np.searchsorted(ends[short], low + _STRETCH, side="right"))
        own = short[a:b]
        high = int(ends[own[-1]])
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[data[low:high]] * _POWERS[: high - low], out=sums[1:])
        first, last = begins[own] - low, ends[own] - low
        out[own] = (sums[last] - sums[first]) * _INVERSES[first] + (last - first).astype(np.uint64)
        a = b
    for k in np.flatnonzero(ends - begins > LONG).tolist():
        word = data[begins[k] : ends[k]].tobytes()
        out[k] = xxhash.xxh3_64_intdigest(word.lower() if fold else word)
    return np.maximum(mix64(out), np.uint64(16))


def word_spans(data: np.ndarray, most: int = 1 << 24) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of bytes that are no ASCII white space."""
    begins, ends = [], []
    before = True
    for low in range(0, len(data), most):
        blank = _BLANK[data[low : low + most]]
        edge = np.empty(len(blank), bool)
        edge[0] = blank[0] != before
        np.not_equal(blank[1:], blank[:-1], out=edge[1:])
        at = np.flatnonzero(edge)
        rising = ~blank[at]
        begins.append(at[rising] + low)
        ends.append(at[~rising] + low)
        before = bool(blank[-1])
    if not before:
        ends.append(np.array([len(data)]))
    join = lambda parts: np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64)
    return join(begins), join(ends)


def texts_in_one(all_texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a blank after each, and the places after those blanks."""
    lengths = np.fromiter(map(len, all_texts), np.int64, len(all_texts)) + 1
    return np.frombuffer(b" ".join([*all_texts, b""]), np.uint8), np.cumsum(lengths)


class Words:
    """Words of some texts in order: hashes, spans in ``data``, and how many each text has."""

    def __init__(self, all_texts: list[bytes], fold: bool = True):
        self.data, ends = texts_in_one(all_texts)
        self.begins, self.ends = word_spans(self.data)
        self.hashes = hash_spans(self.data, self.begins, self.ends, fold)
        self.counts = np.diff(np.searchsorted(self.begins, ends), prepend=0)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, in the order in which they come, and the place of each hash among them."""
    coded = pc.dictionary_encode(pa.array(hashes))
    return np.asarray(coded.dictionary), np.asarray(coded.indices)


def first_places(of: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` numbers comes first in ``of``."""
    out = np.empty(n, np.int64)
    out[of[::-1]] = np.arange(len(of) - 1, -1, -1)
    return out


class Slots:
    """Numbers 0, 1, 2, ... of 64-bit keys in the order in which they were added; open addressing in arrays.

    Keys are hashes (well mixed) and not 0.
    """

    def __init__(self, bits: int = 16):
        self.count = 0
        self._grow(bits)

    def _grow(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for keys that were not added."""
        out = np.full(len(keys), -1, np.int64)
        live = np.arange(len(keys))
        at = keys & self.mask
        while len(live):
            seen = self.keys[at]
            hit = seen == keys[live]
            out[live[hit]] = self.numbers[at[hit]]
            on = ~hit & (seen != 0)
            live, at = live[on], (at[on] + np.uint64(1)) & self.mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number distinct keys that are not there yet."""
        numbers = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        self.count += len(keys)
        if 2 * self.count > len(self.keys):
            old = np.flatnonzero(self.keys)
            keys, numbers = np.concatenate([self.keys[old], keys]), np.concatenate([self.numbers[old], numbers])
            self._grow(max(16, int(4 * self.count - 1).bit_length()))
        at = keys & self.mask
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            own = free & (self.keys[at] == keys)
            self.numbers[at[own]] = numbers[own]
            keys, numbers, at = keys[~own], numbers[~own], (at[~own] + np.uint64(1)) & self.mask


def spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every stretch, one stretch after another."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
