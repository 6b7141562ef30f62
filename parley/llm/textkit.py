"""Vectorised text kernels used inside Arrow tasks.

A task receives Arrow string columns; everything here works on their raw UTF-8 buffers with numpy, a bounded slice of
texts at a time, so that a task's memory does not depend on how many rows a batch holds (only on its longest text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2, _BASE = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word: everything but space and U+0009 to U+000D (all of them ASCII, so bytes and code points agree).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word after lower-casing: digits, letters a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U(33))
    x = x * _M1
    x ^= x >> U(33)
    x *= _M2
    x ^= x >> U(33)
    return x


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), U(base & (2**64 - 1)))
        steps[0] = 1
        have = _powers[kind] = np.multiply.accumulate(steps)
    return have[:n]


def texts(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, offsets) of a string column of about `limit` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs inside each text, and each text's range in them."""
    n = len(is_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.zeros(n, dtype=bool)
    before[1:] = is_word[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = is_word[1:]
    edge = offsets[1:-1]
    before[edge[edge < n]] = False
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, from which the hash of any span follows."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    terms = _RANDOM[data]
    terms *= _power("up", _BASE, len(data))
    np.cumsum(terms, out=sums[1:])
    return sums


def summed_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes behind `sums`, wherever it stands."""
    value = (sums[ends] - sums[starts]) * _power("down", _INVERSE, len(sums))[starts]
    return mix(value + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial over prefix sums, so the cost is per byte, not per span."""
    return summed_hashes(byte_sums(data), starts, ends)


def hash_bytes(word: bytes) -> int:
    """span_hashes of one byte string."""
    data = np.frombuffer(word, dtype=np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(word)]))[0])


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE):
    """(hashes, word range of each text, starts, ends, lowered bytes) of a slice from texts()."""
    low = LOWER[data]
    starts, ends, at = spans(table[low], offsets)
    return span_hashes(low, starts, ends), at, starts, ends, low


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text; with fewer words the whole sequence is the only one; none if empty."""
    k = min(n, len(words))
    if not k:
        return words
    m = len(words) - k + 1
    out = words[:m].copy()
    for j in range(1, k):
        out *= U(0x9FB21C651E98DF25)
        out += words[j : j + m]
    return mix(out + U(k))


def run_hashes(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run words[first:end], by the same prefix sums as for bytes."""
    n = len(words)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * _power("up", _BASE, n), out=sums[1:])
    return mix((sums[end] - sums[first]) * _power("down", _INVERSE, n + 1)[first] + (end - first).astype(np.uint64))


def binary(rows: np.ndarray) -> pa.Array:
    """A uint8 matrix as a binary column, one value per row."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal lengths without nulls as a uint8 matrix."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, dtype=np.int32)[column.offset])
    return np.frombuffer(data, dtype=np.uint8)[first : first + len(column) * width].reshape(len(column), width)


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    """A list<int64> column from uint64 arrays."""
    at = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
