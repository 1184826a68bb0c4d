"""Text kernels over Arrow string columns, as NumPy operations on their bytes.

A column is seen as one byte buffer with document offsets. Words, tokens and
sentence units are found and hashed for all documents of a slice at once; there
is no Python loop over words.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_R, _RINV = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = [np.ones(1, U), np.ones(1, U)]

#: Classes of bytes: 0 white space and controls, 1 letters, digits and all of UTF-8 beyond ASCII, 2 other signs.
CLASS = np.full(256, 2, np.uint8)
CLASS[:33] = 0
CLASS[127] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    CLASS[_a:_b] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: About so many bytes of text are worked on at once.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that all bits depend on all bits."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_R, _RINV)):
            p = np.full(max(n, SLICE >> 2), base, U)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is as ''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


@functools.cache
def _trimmer():
    """The C library's malloc_trim, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give freed memory back: workers live on between stages, and would keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    if own := _trimmer():
        own(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text each; no text is cut. After the last of them memory is given back."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    trim()


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters; the length in bytes stays."""
    out = _LOWER[buf]
    if len(buf) > 1:
        second = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[second] += 32
    return out


def runs(kinds: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of maximal runs of one non-zero kind that cross no document; first[d]:first[d + 1] are those of document d."""
    n = len(kinds)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=edge[1:n])
    edge[off] = True
    live = kinds != 0
    starts = np.flatnonzero(edge[:-1] & live)
    ends = np.flatnonzero(edge[1:] & live) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, which don't overlap and rise, by prefix sums of a polynomial modulo 2**64.

    Sums are taken over runs of ranges of a quarter of a slice each, so a very
    long text needs no more memory than others.
    """
    out = np.empty(len(starts), U)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (SLICE >> 2), side="right")))
        base = starts[lo]
        part = buf[base : ends[hi - 1]]
        power, inverse = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum((part.astype(U) + U(1)) * power[: len(part)], out=sums[1:])
        a, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((sums[e] - sums[a]) * inverse[a] + (e - a).astype(U))
        lo = hi
    return out


def words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, offsets, start, end, first, hash) of the words of a column: runs of letters and digits, folded."""
    raw, off = bytes_of(column)
    buf = fold(raw)
    starts, ends, first = runs((CLASS[buf] == 1).view(np.uint8), off)
    return buf, off, starts, ends, first, hashes(buf, starts, ends)


def doc_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, first) of each document's distinct n-grams of word hashes, sorted; a document of 1 to n - 1 words has one shingle of all of them."""
    count = np.diff(first)
    grams = h.copy()
    total = len(h)
    for k in range(1, n):
        nxt = np.zeros(total, U)
        nxt[: max(0, total - k)] = h[k:]
        grams = mix(grams * U(3) + nxt + U(k))
    sets, sizes = [], []
    for a, c in zip(first[:-1].tolist(), count.tolist()):
        if c >= n:
            s = np.unique(grams[a : a + c - n + 1])
        elif c:
            g = h[a : a + 1].copy()
            for k in range(1, c):
                g = mix(g * U(3) + h[a + k] + U(k))
            s = mix(g + U(0xABCD + c))
        else:
            s = h[:0]
        sets.append(s)
        sizes.append(len(s))
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return (np.concatenate(sets) if sets else h[:0]), out


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, type=kind))
