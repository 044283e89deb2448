"""Vectorised kernels over the bytes of an Arrow string column.

A word boundary that depends on ASCII alone is found on UTF-8 bytes, so whole
batches are cut and hashed with a few numpy passes and no Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass handles; a longer text makes a pass of its own.
SEGMENT = 1_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def fold_table() -> np.ndarray:
    """Each byte, with A-Z lower-cased."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def alnum_class() -> np.ndarray:
    """Bytes of words after lower-casing: digits, letters and all of non-ASCII text."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


def nonspace_class() -> np.ndarray:
    """Bytes other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    t = np.ones(256, dtype=bool)
    t[0x20] = False
    t[0x09:0x0E] = False
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of SplitMix, a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_values(seed: int = 1) -> np.ndarray:
    """A random 64-bit value for each byte, the same for upper and lower case."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE) + _U(seed * 0x632BE59BD9B4E019 & (2**64 - 1)))
    return v[fold_table()]


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self, base: int = _BASE) -> None:
        self.base, self.inv = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, b, dtype=np.uint64)])) for b in (self.base, self.inv))
        return self.up[:n], self.down[:n]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string or binary column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = col.buffers()
    offs = np.frombuffer(at, dtype=np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def segments(offs: np.ndarray, most: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def cut(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; no word crosses rows."""
    m = is_word[data]
    if not m.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    full = offs[1:] > offs[:-1]
    a, b = offs[:-1][full], offs[1:][full] - 1
    first[a] |= m[a]
    last[b] |= m[b]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def prefix(data: np.ndarray, values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of the polynomial hash, one more than there are bytes."""
    up, _ = powers.to(len(data) + 1)
    h = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[:-1], out=h[1:])
    return h


def span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray, powers: Powers) -> np.ndarray:
    """The hash of each span of bytes, the same wherever the span stands."""
    _, down = powers.to(len(h))
    return mix((h[e] - h[s]) * down[s])


def word_hashes(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray, values: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and 64-bit hash of every word."""
    s, e, row = cut(data, offs, is_word)
    return s, e, row, span_hash(prefix(data, values, powers), s, e, powers)
