"""Token ids in a wavelet matrix per shard.

A shard is a run of whole documents of about ``shard_tokens`` tokens. Its ids
are stored as bit-planes, from the highest bit on; after each plane the tokens
with a 0 go before those with a 1, stably. Planes are cut into blocks, each
compressed by itself and listed with its place and the number of ones before
it, so access, rank, count and occurrence lookup inflate only the blocks they
touch.

File: magic, length of the header, header (JSON), then the sections.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import prepare
from .tokens import VOCABULARY, encode, encoding

MAGIC, BLOCK, SHARD_TOKENS = b"TWWM0001", 1 << 15, 1 << 22
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def build(ids: np.ndarray, first: np.ndarray, doc_ids: list[int | None], vocabulary: int, block: int = BLOCK) -> bytes:
    """The file of one shard; first[d]:first[d + 1] are the tokens of document d, and a block has ``block`` bytes of bits."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    levels = max(1, int(vocabulary - 1).bit_length())
    cur = np.asarray(ids, np.uint16 if levels <= 16 else np.uint32)
    body, planes, at = [], [], 0

    def put(raw: bytes) -> list[int]:
        nonlocal at
        z = squeeze(raw)
        body.append(z)
        at += len(z)
        return [at - len(z), len(z)]

    for level in range(levels):
        one = ((cur >> (levels - 1 - level)) & 1).astype(bool)
        packed = np.packbits(one, bitorder="little")
        before, blocks = 0, []
        for k in range(0, len(packed), block):
            part = packed[k : k + block]
            blocks.append([*put(part.tobytes()), before])
            before += int(_ONES[part].sum())
        planes.append({"zeros": len(cur) - before, "blocks": blocks})
        cur = np.concatenate([cur[~one], cur[one]])
    known = [x is not None for x in doc_ids]
    head = {"n": len(ids), "levels": levels, "block": block, "vocabulary": vocabulary, "planes": planes, "docs": len(doc_ids)}
    head["first"] = put(np.asarray(first, "<i8").tobytes())
    head["ids"] = put(np.array([x if x is not None else 0 for x in doc_ids], "<i8").tobytes())
    head["known"] = put(np.array(known, np.uint8).tobytes())
    text = json.dumps(head).encode()
    return b"".join([MAGIC, struct.pack("<I", len(text)), text, *body])


class WaveletShard:
    """Reads one file; positions count from 0 within the shard."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        (n,) = struct.unpack("<I", data[8:12])
        self.head, self.body, self._cache = json.loads(data[12 : 12 + n]), memoryview(data)[12 + n :], {}
        self.n, self.levels, self.planes = self.head["n"], self.head["levels"], self.head["planes"]

    def _raw(self, at: int, size: int) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(self.body[at : at + size])

    def _array(self, name: str, kind) -> np.ndarray:
        return np.frombuffer(self._raw(*self.head[name]), kind)

    @property
    def first(self) -> np.ndarray:
        return self._array("first", "<i8")

    @property
    def doc_ids(self) -> list[int | None]:
        return [int(x) if k else None for x, k in zip(self._array("ids", "<i8"), self._array("known", np.uint8))]

    def _block(self, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        if (level, k) not in self._cache:
            at, size, before = self.planes[level]["blocks"][k]
            raw = np.frombuffer(self._raw(at, size), np.uint8)
            self._cache[level, k] = raw, before + np.r_[0, np.cumsum(_ONES[raw])]
        return self._cache[level, k]

    def _bits_ranks(self, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bit at i, ones before i) for positions 0 to n; the bit at n is 0."""
        per = self.head["block"] * 8
        bit, rank = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        inside = i < self.n
        rank[~inside] = self.n - self.planes[level]["zeros"]
        for k in np.unique(i[inside] // per):
            here = np.flatnonzero(inside & (i // per == k))
            raw, ones = self._block(level, int(k))
            j = i[here] - k * per
            byte, low = raw[j >> 3], j & 7
            bit[here] = (byte >> low) & 1
            rank[here] = ones[j >> 3] + _ONES[byte & ((1 << low) - 1)]
        return bit, rank

    def access(self, positions) -> np.ndarray:
        """The tokens at the positions."""
        i = np.asarray(positions, np.int64)
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("position beyond the shard")
        out = np.zeros(len(i), np.int64)
        for level in range(self.levels):
            bit, rank = self._bits_ranks(level, i)
            out = out * 2 + bit
            i = np.where(bit == 1, self.planes[level]["zeros"] + rank, i - rank)
        return out

    def document(self, d: int) -> np.ndarray:
        first = self.first
        return self.access(np.arange(first[d], first[d + 1]))

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.levels):
            _, (ra, rb) = self._bits_ranks(level, np.array([a, b]))
            if (token >> (self.levels - 1 - level)) & 1:
                z = self.planes[level]["zeros"]
                a, b = z + int(ra), z + int(rb)
            else:
                a, b = a - int(ra), b - int(rb)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often the token occurs in positions a to b - 1."""
        if token < 0 or token >> self.levels:
            return 0
        lo, hi = self._range(token, max(0, a), self.n if b is None else min(b, self.n))
        return max(0, hi - lo)

    def select(self, token: int, k: int) -> int:
        """The position of the token's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError("fewer occurrences")
        i = self._range(token, 0, self.n)[0] + k
        for level in reversed(range(self.levels)):
            z = self.planes[level]["zeros"]
            i = self._select_bit(level, i - z, 1) if (token >> (self.levels - 1 - level)) & 1 else self._select_bit(level, i, 0)
        return i

    def _select_bit(self, level: int, k: int, bit: int) -> int:
        lo, hi = 0, self.n
        while hi - lo > 1:  # the greatest i with fewer than k + 1 such bits before it
            mid = (lo + hi) // 2
            ones = int(self._bits_ranks(level, np.array([mid]))[1][0])
            lo, hi = (mid, hi) if (ones if bit else mid - ones) <= k else (lo, mid)
        return lo

    def locate(self, token: int) -> list[int]:
        """All positions of the token, rising."""
        return [self.select(token, k) for k in range(self.count(token))]


def _shards(path: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        vocabulary = encoding(path).n_vocab
        held, sizes, docs, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, sizes, docs, total, number
            first = np.r_[0, np.cumsum(sizes)].astype(np.int64)
            data = build(np.concatenate(held), first, docs, vocabulary)
            known = [d for d in docs if d is not None]
            out = pa.RecordBatch.from_arrays(
                [pa.array([f"{part:06d}-{number:04d}"]), pa.array([len(docs)], pa.int64()), pa.array([total], pa.int64()), pa.array([min(known, default=None)], pa.int64()), pa.array([max(known, default=None)], pa.int64()), pa.array([data], pa.binary())],
                names=["shard", "n_docs", "n_tokens", "least_doc_id", "greatest_doc_id", "data"],
            )
            held, sizes, docs, total, number = [], [], [], 0, number + 1
            return out

        for whole in batches:
            for b in tv.slices(whole, "text", 1 << 20):
                ids, first = encode(b.column("text").to_pylist(), path)
                held.append(ids.astype(np.uint16 if vocabulary <= 1 << 16 else np.uint32))
                sizes += np.diff(first).tolist()
                docs += b.column("doc_id").to_pylist()
                total += len(ids)
                if total >= most:
                    yield flush()
        if docs:
            yield flush()

    return run


def wavelet_shards(docs: DataFrame, path: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(shard, n_docs, n_tokens, least_doc_id, greatest_doc_id, data): one file a shard, as bytes.

    Shards are made where the documents are read, without a shuffle; a shard is
    full once it has ``shard_tokens`` tokens, and the last of a partition may be
    smaller; a text of any length is in one shard. A null or empty text is a document of no tokens; a null doc_id is
    kept as unknown; rows that repeat a doc_id are documents of their own. Other
    columns, whatever their names, are not read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_shards(path, shard_tokens), "shard string, n_docs long, n_tokens long, least_doc_id long, greatest_doc_id long, data binary")


def write_shards(shards: DataFrame, folder: str) -> None:
    """Each shard as a file ``folder/shard.wm``, written by the executors; the folder must be shared."""

    def write(rows):
        from pathlib import Path

        for r in rows:
            Path(folder, f"{r['shard']}.wm").write_bytes(bytes(r["data"]))

    shards.foreachPartition(write)
