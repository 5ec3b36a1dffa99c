"""Vectorised word splitting and hashing over Arrow string columns.

The helpers work on slices of about ``SLICE`` bytes of a column's UTF-8 buffer.
A text is never split between two slices; the words of a longer text are found
and hashed in pieces of ``SLICE`` bytes, so that beside the text only its words'
places and hashes (about 32 bytes a word) are held.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time (a longer text is taken alone).
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def _byte_table(members) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes of `[^\x20\x09-\x0D]+`: all but space and the five ASCII controls.
SPACED = ~_byte_table([0x20, *range(0x09, 0x0E)])
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` in lower-cased text.
ALNUM = _byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_CODES = np.random.default_rng(20240901).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers below n, and their inverses, modulo 2**64."""

    def powers(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(SLICE, 1 << int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string or binary column; a null is empty."""
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of the texts of a slice.

    ``starts`` and ``ends`` are byte positions in the slice, ``doc`` is the row
    in the slice, ``first`` the index of each row's first word (one more entry
    than rows), ``hash`` a 64-bit hash of each word's bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        self.data, self.offsets = data, offsets - offsets[0]
        self.member = member[data]
        bound = np.zeros(len(data) + 1, bool)
        bound[self.offsets] = True
        starts, ends = [], []
        for lo in range(0, len(data), SLICE):
            hi = min(lo + SLICE, len(data))
            here = self.member[lo:hi]
            around = np.zeros(hi - lo + 2, bool)
            around[1:-1] = here
            around[0], around[-1] = lo > 0 and self.member[lo - 1], hi < len(data) and self.member[hi]
            starts.append(np.flatnonzero(here & (~around[:-2] | bound[lo:hi])) + lo)
            ends.append(np.flatnonzero(here & (~around[2:] | bound[lo + 1 : hi + 1])) + (lo + 1))
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span of the slice; spans are in order of their starts."""
        out = np.empty(len(starts), np.uint64)
        k = 0
        while k < len(starts):
            # spans that start in a piece; the piece's sums go on to the end of the longest of them
            to = max(k + 1, int(np.searchsorted(starts, starts[k] + SLICE, "left")))
            lo, hi = int(starts[k]), int(ends[k:to].max())
            power, inverse = _powers_for(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum(_CODES[self.data[lo:hi]] * power[: hi - lo], out=sums[1:])
                a, b = starts[k:to] - lo, ends[k:to] - lo
                out[k:to] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
            k = to
        return out

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.span_hash(self.starts, self.ends)
        return self._hash


def word_slices(column: pa.Array, member: np.ndarray, lower: bool = False, limit: int = SLICE) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words) of each slice of a column."""
    data, offsets = buffers(column)
    for lo, hi in slices(offsets, limit):
        part = data[offsets[lo] : offsets[hi]]
        yield lo, hi, Words(LOWER[part] if lower else part, offsets[lo : hi + 1], member)


def hash_word(word: str | bytes) -> int:
    """The hash that ``Words.hash`` gives to a word."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    w = Words(raw, np.array([0, len(raw)]), np.ones(256, bool))
    return int(w.span_hash(np.array([0]), np.array([len(raw)]))[0])


def hash_windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` values (empty if there are fewer)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(_BASE) + h[k : k + n]
    return mix(out)
