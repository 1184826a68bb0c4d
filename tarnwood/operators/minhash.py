"""One-permutation MinHash signatures of byte n-grams, densified, and Jaccard estimates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwood.functions import hashing as H
from tarnwood.session import prepare

U = np.uint64
EMPTY = (1 << 32) - 1


def bin_minima(text: bytes, k: int = 256, least: int = 3, most: int = 5, seed: int = 0, family: str = "splitmix64") -> np.ndarray:
    """The least high half of the hashes that fall into each of k bins; EMPTY where none does."""
    buf = np.frombuffer(text, np.uint8)
    h = np.concatenate([H.window_hashes(buf, n, seed, family) for n in range(least, most + 1)])
    out = np.full(k, EMPTY, np.int64)
    np.minimum.at(out, (h % U(k)).astype(np.int64), (h >> U(32)).astype(np.int64))
    return out


def densify(slots: np.ndarray, seed: int = 0) -> np.ndarray:
    """Empty bins borrow from the next filled one at a keyed stride, mixed with its distance; bins filled so may lend in turn.

    ``slots`` has a row a document, or is one row. Bins are gone through in
    order, all rows at once; a bin that a row has filled costs that row nothing.
    """
    out = np.array(slots, np.int64, ndmin=2)
    k = out.shape[1]
    step = int(H.mix(U(seed))) | 1
    turns = np.arange(1, k + 1)
    for i in range(k):
        rows = np.flatnonzero(out[:, i] == EMPTY)
        if not len(rows):
            continue
        places = ((U(i) + turns.astype(U) * U(step)) & U(0xFFFFFFFF)).astype(np.int64) % k
        filled = out[rows][:, places] != EMPTY
        r = filled.argmax(1)
        lent = out[rows, places[r]].astype(U) << U(32) | turns[r].astype(U)
        value = np.where(filled.any(1), H.mix(lent), H.mix(U(seed ^ i)))
        out[rows, i] = (value & U(0xFFFFFFFF)).astype(np.int64)
    return out.reshape(np.shape(slots))


def signatures(docs: DataFrame, k: int = 256, least: int = 3, most: int = 5, seed: int = 0, family: str = "splitmix64", dense: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, signature array<long>) of each row."""
    if k < 1:
        raise ValueError("k must be positive")
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [bin_minima((t or "").encode(), k, least, most, seed, family) for t in b.column(1).to_pylist()]
            flat = np.stack(rows) if rows else np.empty((0, k), np.int64)
            flat = (densify(flat, seed) if dense and rows else flat).reshape(-1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(flat))], names=[key, "signature"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, signature array<long>")


def jaccard(a: Column, b: Column) -> Column:
    """The share of equal slots of two signatures of one size; 0 for empty ones."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    sized = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("signatures differ in size")).cast("double"))
    return sized.when(F.size(a) == 0, 0.0).otherwise(same / F.size(a))
