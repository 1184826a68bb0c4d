"""Seeded 64-bit hashes of byte strings, as NumPy operations over whole columns.

Strings are hashed in groups of one length, each group as a matrix of bytes.
``xxhash64`` of Spark is the fourth family, at its own seed of 42, without Python.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
M1, M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
P1, P2, P3, P4, P5 = map(U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def mix(z) -> np.ndarray:
    """SplitMix64's finaliser."""
    z = np.asarray(z, U)
    with np.errstate(over="ignore"):
        z = (z ^ (z >> U(30))) * M1
        z = (z ^ (z >> U(27))) * M2
    return z ^ (z >> U(31))


def _word(m: np.ndarray, at: int, n: int) -> np.ndarray:
    """Bytes at to at + n - 1 of each row as a little-endian number."""
    out = np.zeros(len(m), U)
    for i in range(n):
        out |= m[:, at + i].astype(U) << U(8 * i)
    return out


def splitmix(m: np.ndarray, seed: int = 0) -> np.ndarray:
    """The default family, of the rows of a byte matrix."""
    n = m.shape[1]
    h = np.full(len(m), mix(U(seed) ^ GOLDEN), U)
    whole = n - n % 8
    for at in range(0, whole, 8):
        h = mix(h ^ _word(m, at, 8))
    if whole < n:
        h = mix(h ^ _word(m, whole, n - whole) ^ U((n - whole) << 56))
    return mix(h ^ U(n))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(m: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of the rows of a byte matrix."""
    n, s = m.shape[1], U(seed)
    rows, at = len(m), 0
    with np.errstate(over="ignore"):
        lane = lambda acc, x: _rotl(acc + x * P2, 31) * P1
        if n >= 32:
            acc = [np.full(rows, v, U) for v in (s + P1 + P2, s + P2, s, s - P1)]
            while at + 32 <= n:
                acc = [lane(a, _word(m, at + 8 * i, 8)) for i, a in enumerate(acc)]
                at += 32
            h = sum((_rotl(a, r) for a, r in zip(acc, (1, 7, 12, 18))), np.zeros(rows, U))
            for a in acc:
                h = (h ^ lane(np.zeros(rows, U), a)) * P1 + P4
        else:
            h = np.full(rows, s + P5, U)
        h = h + U(n)
        while at + 8 <= n:
            h = _rotl(h ^ lane(np.zeros(rows, U), _word(m, at, 8)), 27) * P1 + P4
            at += 8
        if at + 4 <= n:
            h = _rotl(h ^ (_word(m, at, 4) * P1), 23) * P2 + P3
            at += 4
        for i in range(at, n):
            h = _rotl(h ^ (m[:, i].astype(U) * P5), 11) * P1
        h = (h ^ (h >> U(33))) * P2
        h = (h ^ (h >> U(29))) * P3
    return h ^ (h >> U(32))


@functools.cache
def _castagnoli() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


def crc32c(m: np.ndarray, seed: int = 0) -> np.ndarray:
    """CRC-32C, widened to 64 bits with seed and length."""
    table = _castagnoli()
    c = np.full(len(m), ~np.uint32(seed & 0xFFFFFFFF), np.uint32)
    for i in range(m.shape[1]):
        c = table[(c ^ m[:, i]) & 0xFF] ^ (c >> np.uint32(8))
    wide = (~c).astype(U)
    return mix((wide << U(32)) ^ wide ^ U(seed) ^ U(m.shape[1] << 24))


@functools.lru_cache(8)
def _tables(seed: int) -> np.ndarray:
    """Six tables of 256 entries: four for byte places, two for bytes of the hash itself."""
    out, s = np.zeros((6, 256), U), U(seed) ^ U(0x51D3A97B0E68C42F)
    with np.errstate(over="ignore"):
        for t in range(6):
            for i in range(256):
                s = mix(s + U(i))[()]
                out[t, i] = s
            s = mix(s ^ GOLDEN)[()]
    return out


def tabulation(m: np.ndarray, seed: int = 0) -> np.ndarray:
    """Mixed tabulation."""
    t = _tables(seed)
    h = np.zeros(len(m), U)
    for i in range(m.shape[1]):
        h ^= t[i % 4][m[:, i]]
    h ^= mix(U(m.shape[1]))
    h ^= t[4][(h & U(255)).astype(np.int64)]
    return h ^ t[5][((h >> U(8)) & U(255)).astype(np.int64)]


FAMILIES: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"splitmix64": splitmix, "xxh64": xxh64, "crc32c": crc32c, "tabulation": tabulation}


def hash64(items: list[bytes], seed: int = 0, family: str = "splitmix64") -> np.ndarray:
    """The hash of each string."""
    if family not in FAMILIES:
        raise ValueError(f"no hash family {family!r}")
    sizes = np.array([len(x) for x in items], np.int64)
    out = np.zeros(len(items), U)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        m = np.frombuffer(b"".join(items[i] for i in at), np.uint8).reshape(len(at), n)
        out[at] = FAMILIES[family](m, seed)
    return out


def window_hashes(buf: np.ndarray, k: int, seed: int = 0, family: str = "splitmix64") -> np.ndarray:
    """The hashes of all windows of k bytes of one text."""
    if len(buf) < k:
        return np.zeros(0, U)
    return FAMILIES[family](np.lib.stride_tricks.sliding_window_view(buf, k), seed)
