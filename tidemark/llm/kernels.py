"""Vectorised byte kernels over blocks of UTF-8 texts (numpy, no Spark).

A *block* is one ``uint8`` array that holds several texts back to back and the
array of their offsets.  Words, word hashes and window hashes of a whole block
are computed with a fixed number of numpy passes, so memory is a small multiple
of the block's bytes whatever the documents look like.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are gathered up to so many bytes before they are worked on together.
BLOCK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WINDOW_BASE = 0xD6E8FEB86659FD93 | 1
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept between calls."""
    have = _tables.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(steps, dtype=np.uint64)
        _tables[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batch: pa.RecordBatch, name: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``most`` bytes; one longer text is a run of its own."""
    data, off = utf8(batch.column(name))
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def table(keep) -> np.ndarray:
    """A look-up table of 256 booleans: which bytes belong to a word."""
    return np.array([bool(keep(b)) for b in range(256)])


#: Bytes of words that white space separates: not x20, x09-x0D.
NOT_SPACE = table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of words of letters and digits after lower-casing A-Z: 0-9, a-z and all beyond ASCII.
ALNUM = table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z, any other byte to itself.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of member bytes inside one text, and the text's number."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = member[data]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    inner = off[:-1][off[:-1] < len(data)]
    before[inner] = False
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    after[inner[inner > 0] - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair, equal for equal bytes wherever they stand."""
    n = len(data)
    up, down = powers(_BASE, n + 1), powers(_INVERSE, n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive word hashes (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    up = powers(_WINDOW_BASE, n)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for j in range(n):
            out += h[j : j + m] * up[j]
        return mix(out)


def sliding(h: np.ndarray, w: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) of each w consecutive entries, by doubling: O(n log w)."""
    f = np.minimum if least else np.maximum
    if len(h) < w:
        return h[:0]
    out, k = h, 1
    while 2 * k <= w:
        out = f(out[:-k], out[k:])
        k *= 2
    return f(out[: len(h) - w + 1], out[w - k : w - k + len(h) - w + 1]) if k < w else out


def covered(n: int, starts: np.ndarray, lengths) -> np.ndarray:
    """Which of n positions lie in any [start, start + length)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + lengths, n), -1)
    return np.cumsum(d[:n]) > 0


def release() -> None:
    """Gives freed memory back to the system: workers live on, and would hold on to the most they ever used."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
