"""Vectorised text kernels shared by the corpus operators.

Texts of an Arrow batch are seen as one byte buffer with document offsets. Words and
substrings are hashed with a polynomial over Z/2^64 whose byte values are random, so a hash
of any span is one subtraction and one product of prefix sums. Hashes only propose; operators
compare content (or 128 bits of it) before they decide.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SEGMENT = 1 << 20
BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = np.ones(256, bool)
for lo, hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM[lo : hi + 1] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, kept up to SEGMENT entries."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, np.uint64)
        out[0] = 1
        done, step = 1, base
        while done < size:
            take = min(done, size - done)
            out[done : done + take] = out[:take] * np.uint64(step)
            done += take
            step = step * step % (1 << 64)
        if size <= 4 * SEGMENT:
            _powers[base] = out
        return out[:n]
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for ascending, non-nested spans, in bounded memory."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, side="right")))
        lo, hi = int(start[i]), int(end[j - 1])
        prefix = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTE[buf[lo:hi]] * _power(BASE, hi - lo), out=prefix[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (prefix[e] - prefix[s]) * _power(INVERSE, hi - lo + 1)[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def window_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all substrings of that size."""
    n = len(buf)
    if n < size:
        return np.empty(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[buf] * _power(BASE, n), out=prefix[1:])
    return mix((prefix[size:] - prefix[: n + 1 - size]) * _power(INVERSE, n + 1)[: n + 1 - size])


def row_hashes(values: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of every `size` consecutive values (word hashes to shingle hashes)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for i in range(size):
        out *= np.uint64(BASE)
        out += values[i : i + n]
    return mix(out)


def words(buf: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes of `kind` that cross no document bound, and
    for each document the index of its first word (one more entry than documents)."""
    n = len(buf)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    w = kind[buf]
    first = w.copy()
    first[1:] &= ~w[:-1]
    cut = bounds[(bounds > 0) & (bounds < n)]
    first[cut] |= w[cut]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[cut - 1] |= w[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, bounds)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by block-wise running minima."""
    n = len(values)
    if width <= 1 or n < width:
        return values.copy() if width <= 1 else values[:0]
    padded = -(-n // width) * width
    blocks = np.full(padded, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of range(start[i], start[i] + length[i])."""
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    keep = length > 0
    s, n = start[keep], length[keep]
    at = np.concatenate(([0], np.cumsum(n)[:-1]))
    out[at] = s
    out[at[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Flags of positions inside any [start, end)."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:size]) > 0


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its offsets, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def give_back() -> None:
    """Returns freed memory to the system: a Python worker outlives its task, and what it keeps
    counts against its executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def pieces(batches, column: str, limit: int = SEGMENT) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with about `limit` bytes of text (one text at least), each with its
    byte buffer and offsets."""
    for batch in batches:
        data, bounds = text_buffer(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i), data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            i = j
        del batch, data, bounds
        give_back()


def slices(batches, column: str, limit: int = 2 * SEGMENT) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about `limit` bytes of text."""
    for part, _, _ in pieces(batches, column, limit):
        yield part
