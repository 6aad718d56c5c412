"""Whole Arrow batches of texts to word hashes, with numpy and without a Python
object for each word.

A word's hash is a polynomial over random 64-bit values of its bytes, modulo 2**64,
then mixed; two different words agree with a chance of about 2**-60. The hash of any
prefix of a word costs no more than the hash of the word, so prefixes can serve as
features. Texts of any length are read in blocks, so that memory stays at about
two bytes for each byte of text and 24 for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_P_INV = pow(_P, -1, 1 << 64)
#: Bytes hashed at once, and bytes of text given to one call at most unless a single text is longer.
BLOCK, CHUNK = 1 << 18, 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_CASED = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))

_is_space = np.zeros(256, bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words that end at white space.
BY_SPACE = ~_is_space
#: Bytes of words of digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_pows: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pows or len(_pows[0]) < n:
        size = max(n, 2 * BLOCK)
        for k, base in enumerate((_P, _P_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _pows[k : k + 1] = [np.multiply.accumulate(out)]
    return _pows[0][:n], _pows[1][:n]


@dataclass
class Words:
    """Words of a chunk of texts, in order. row: the text of each; first: index of
    each text's first word, with the number of words at the end."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray
    cased: bool = False

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, prefixes: tuple[int, ...] = ()) -> np.ndarray | list[np.ndarray]:
        """The hash of each word; with prefixes also, as further arrays, those of the
        first k bytes of each word (of shorter words 0)."""
        table = _CASED if self.cased else _BYTE
        n = len(self.starts)
        out = [np.zeros(n, np.uint64) for _ in range(1 + len(prefixes))]
        i = 0
        while i < n:
            lo = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, lo + BLOCK, side="right")))
            hi = int(self.ends[j - 1])
            power, inverse = _powers(hi - lo)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(table[self.buf[lo:hi]] * power, out=total[1:])
            s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[0][i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
            for into, k in zip(out[1:], prefixes, strict=True):
                long = e - s > k
                at = s[long]
                into[i:j][long] = mix((total[at + k] - total[at]) * inverse[at] + np.uint64(k << 32))
            i = j
        return out if prefixes else out[0]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and where each begins (and the last ends). Null is empty."""
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def find_words(buf: np.ndarray, at: np.ndarray, word_bytes: np.ndarray, cased: bool = False) -> Words:
    inside = word_bytes[buf]
    before = np.zeros(len(buf), bool)
    after = np.zeros(len(buf), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = at[:-1][at[:-1] < at[1:]]
    before[edges] = False
    after[edges[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(buf, starts, ends, row, first, cased)


def chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about size bytes."""
    buf, at = text_buffer(col)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, j, buf[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_chunks(col: pa.Array, word_bytes: np.ndarray, cased: bool = False, size: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    for i, j, buf, at in chunks(col, size):
        yield i, j, find_words(buf, at, word_bytes, cased)


class HashSet:
    """A fixed set of hashes; find() gives each hash's place in the sorted set, or -1.
    A bit table turns most absent ones away first."""

    def __init__(self, hashes: np.ndarray):
        self.keys = np.unique(hashes.astype(np.uint64))
        self.bits = max(12, min(24, int(len(self.keys)).bit_length() + 4))
        self.shift = np.uint64(64 - self.bits)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.keys >> self.shift] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        if len(self.keys):
            maybe = np.flatnonzero(self.table[hashes >> self.shift])
            look = hashes[maybe]
            at = np.minimum(np.searchsorted(self.keys, look), len(self.keys) - 1)
            good = self.keys[at] == look
            out[maybe[good]] = at[good]
        return out
