"""Vectorised text kernels shared by the operators of this subpackage.

A column of texts is handled as one UTF-8 byte buffer plus row offsets, the
layout Arrow already uses, so that splitting into words and hashing them costs
a few numpy passes over the bytes and no Python object for each word.  Nulls
count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Default bytes of text handled in one numpy pass; bounds a worker's memory.
CHUNK = 2_000_000

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POW = np.ones(1, np.uint64)
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        with np.errstate(over="ignore"):
            base = np.full(max(n, 1024), np.uint64(_BASE))
            base[0] = 1
            _POW = np.cumprod(base, dtype=np.uint64)
    return _POW


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (n + 1); a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8) if offs is not None and n else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes: (first row, end row, bytes, offsets)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


#: Bytes that separate bare tokens: white space, other control bytes and ASCII punctuation.
BREAK = np.zeros(256, bool)
BREAK[:128] = [not chr(i).isalnum() for i in range(128)]


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes not in ``breaks``), and for each row the index of its first word (n + 1)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    ink = ~breaks[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | cut[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty, ordered, disjoint span of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
    at += np.arange(len(at))
    value = _BYTE[data[at]]
    at -= np.repeat(starts, lens)
    with np.errstate(over="ignore"):
        value *= _powers(int(lens.max()))[at]
        total = np.add.reduceat(value, np.cumsum(lens) - lens)
        return mix(total + lens.astype(np.uint64) * np.uint64(_BASE))


def counts_in(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set entries of ``mask`` in each row."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return np.diff(total[offsets])


def distinct_in(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Number of distinct keys in each row; ``rows`` are the rows' first indices (n + 1)."""
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(rows) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``k``-word shingles.

    A-Z are lower-cased.  A row of 1 to k-1 words has one shingle, its whole
    sequence; a row without words has none.
    """
    low = LOWER[data]
    starts, ends, rows = words(low, offsets)
    w = spans_hash(low, starts, ends)
    n = len(w)
    with np.errstate(over="ignore"):
        gram = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            gram += w[j : j + len(gram)] * _GRAM[j]
        gram = mix(gram)
        out = []
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(gram[a : b - k + 1]))
            elif b > a:
                short = np.uint64(b - a) * np.uint64(_BASE)
                for j in range(b - a):
                    short = short + w[a + j] * _GRAM[16 + j]
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
