"""Vectorised work on the raw UTF-8 of Arrow string columns: no Python string is built for a text or a word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in runs of about so many bytes, which bounds the arrays that a task holds. A longer text is a run of its own.
CHUNK = 1 << 20
U64 = np.uint64
#: glibc's malloc_trim, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: The separators of the contracts: space and the control characters from tab to carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix64 generator, as a 64-bit mixing function."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODE = splitmix(np.arange(256, dtype=U64) + U64(11))
_P = 0xD1342543DE82EF95
_POWERS = np.ones(1, U64), np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK)
        up, down = np.full(size, _P, U64), np.full(size, pow(_P, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        made = np.cumprod(up), np.cumprod(down)
        if size > 8 * CHUNK:
            return made
        _POWERS = made
    return _POWERS


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offset of each row in them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about limit bytes each."""
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, row + 4096, rows)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, blanks: np.ndarray = BLANKS, fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, text number) of each word of each text, in order."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, none
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~blanks[data]
    edges = offsets[(offsets > 0) & (offsets < n)]
    starts_at = solid[1:] & ~solid[:-1]
    ends_at = solid[:-1] & ~solid[1:]
    cut = edges[solid[edges + 1] & solid[edges]]
    starts_at[cut] = ends_at[cut] = True
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_CODE[fold[data]] * up[:n], out=total[1:])
    hashed = splitmix((total[ends] - total[starts]) * down[starts])
    return hashed, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingles(hashed: np.ndarray, text: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, offset of each text in them). A text of fewer than k words has its whole sequence as one shingle; one without words has none."""
    n = len(hashed)
    bounds = np.searchsorted(text, np.arange(texts + 1))
    counts = np.diff(bounds)
    made = np.zeros(0, U64)
    if n >= k:
        made = hashed[: n - k + 1].copy()
        for j in range(1, k):
            made = splitmix(made * U64(0x9FB21C651E98DF25) + hashed[j : n - k + 1 + j])
    out, sizes = [], np.zeros(texts + 1, np.int64)
    for i in np.flatnonzero(counts):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= k:
            got = np.unique(made[a : b - k + 1])
        else:
            whole = U64(int(b - a) + 1)
            with np.errstate(over="ignore"):
                for h in hashed[a:b]:
                    whole = splitmix(np.array([whole * U64(0x9FB21C651E98DF25) + h], U64))[0]
            got = np.array([whole], U64)
        out.append(got)
        sizes[i + 1] = len(got)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.cumsum(sizes)


def as_binary(pieces: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose row i is pieces[offsets[i]:offsets[i + 1]] as bytes; no copy for each row."""
    width = pieces.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(pieces))])


def released() -> None:
    """Give memory that is free again back to the system. Python workers serve one task after another and would keep what the largest one took."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)
