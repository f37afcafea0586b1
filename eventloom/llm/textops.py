"""Vectorised word tables over Arrow string columns.

Every helper works on whole texts, batch by batch, with memory bounded by
``CHUNK`` bytes of text (one longer text is a chunk of its own).

Words are told apart by their bytes: a chunk's words are dictionary-encoded, and only the
distinct ones are hashed, by a keyed 64-bit hash. Windows of words get Rabin-Karp hashes:
polynomials of word hashes modulo the prime 2**61 - 1 at a fixed random base, so no
structure of the words makes two windows collide more often than chance does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
CHUNK = 2 << 20

#: Windows hashed at once.
WINDOWS = 1 << 15
#: Key of the words' hash.
WORD_KEY = "eventloom words."
PRIME = (1 << 61) - 1
#: Bases of the windows' polynomials; the second one serves where 61 bits are too few.
BASES = (0x1B3A9F0C5D72E681, 0x0C96E15F38AD427B)
_P, _31, _30 = np.uint64(PRIME), np.uint64(31), np.uint64(30)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)

#: A-Z to a-z, byte by byte; UTF-8 bytes over 0x7F stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space (0x20, 0x09-0x0D) separates.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of words of digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a bijection."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunked(offsets: np.ndarray, most: int = CHUNK, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, and of ``rows`` rows at most."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + (rows or n))
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of a run of texts: byte range, row number and hash of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each row, and the total at the end

    def text(self, lo: int, hi: int, sep: bytes = b" ") -> bytes:
        """Words lo to hi, joined."""
        raw, at = self.data[self.start[lo] : self.end[hi - 1]].tobytes(), int(self.start[lo])
        return sep.join(raw[s - at : e - at] for s, e in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True))

    def spans(self, k: int) -> np.ndarray:
        """Mask over words: k words of one row begin here."""
        n = len(self.row)
        ok = np.zeros(n, bool)
        if n >= k:
            ok[: n - k + 1] = self.row[: n - k + 1] == self.row[k - 1 :]
        return ok

    def grams(self, k: int, base: int = 0) -> np.ndarray:
        """Rabin-Karp hash of k words from each word on; see spans()."""
        return rolling(self.hash, k, base)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1, or that number itself."""
    return (x & _P) + (x >> np.uint64(61))


def _times(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo 2**61 - 1, by parts of 31 bits; x is below 2**61 + 8."""
    c1, c0 = np.uint64(c >> 31), np.uint64(c & (1 << 31) - 1)
    x1, x0 = x >> _31, x & _LOW31
    middle = x1 * c0 + x0 * c1
    return _reduced(((x1 * c1) << np.uint64(1)) + (middle >> _30) + ((middle & _LOW30) << _31) + _reduced(x0 * c0))


def rolling(h: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """sum(h[i + j] * B ** j for j < k) modulo 2**61 - 1, mixed; 0 where it doesn't fit."""
    n = len(h)
    out = np.zeros(n, np.uint64)
    for lo in range(0, n - k + 1, WINDOWS):  # stretches that stay in a processor's cache
        own = _polynomials(h[lo : lo + WINDOWS + k - 1], k, base)
        out[lo : lo + len(own)] = own
    return out


def _polynomials(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """One value for each window that fits. By doubling: two halves make a window of twice the length."""
    part, size, acc, got = _reduced(h), 1, None, 0
    want = k
    while True:
        if want & size:
            if acc is None:
                acc, got = part.copy(), size
            else:
                m = min(len(acc), len(part) - got)
                acc = _reduced(acc[:m] + _times(part[got : got + m], pow(BASES[base], got, PRIME)))
                got += size
            want ^= size
        if not want:
            break
        m = len(part) - size
        part = _reduced(part[:m] + _times(part[size:], pow(BASES[base], size, PRIME)))
        size *= 2
    acc = acc[: len(h) - k + 1]
    return mix(np.where(acc >= _P, acc - _P, acc) ^ np.uint64(k))


def distinct(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each of the byte strings laid end to end, equal ones alike, and the distinct strings as objects."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
    column = column.dictionary_encode()
    return column.indices.to_numpy(), column.dictionary.to_numpy(zero_copy_only=False)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False) -> Words:
    """Cut texts to maximal runs of the table's bytes and hash each run."""
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = table[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    begin, stop = offsets[:-1], offsets[1:]
    before[begin[begin < n]] = False
    after[stop[stop > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    number, own = distinct(data[inside], end - start)
    hashes = pd.util.hash_array(own, hash_key=WORD_KEY, categorize=False) if len(own) else np.zeros(0, np.uint64)
    return Words(data, start, end, row, hashes[number], first)


def planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian integers as byte planes, which compress well where high bytes repeat."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes | memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()
