"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of the lengths in n's binary form
(after as many pieces of the greatest length as fit), longest first. Pieces of
one length make up a bucket, so batches of one length need no padding and no
sequence crosses a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import prepare
from .tokens import VOCABULARY, encode

LONGEST = 13


def pieces(count: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece number, start, bucket) of the pieces of documents of these token counts, in order; a piece is 2**bucket long."""
    count = np.asarray(count, np.int64)
    full = count >> longest
    doc = [np.repeat(np.arange(len(count)), full)]
    start = [(np.arange(len(doc[0])) - np.repeat(np.cumsum(full) - full, full)) << longest]
    bucket = [np.full(len(doc[0]), longest)]
    for k in range(longest):
        d = np.flatnonzero((count >> k) & 1)
        doc.append(d)
        start.append((count[d] >> (k + 1)) << (k + 1))
        bucket.append(np.full(len(d), k))
    doc, start, bucket = map(np.concatenate, (doc, start, bucket))
    order = np.lexsort((start, doc))
    doc, start, bucket = doc[order], start[order], bucket[order]
    head = np.searchsorted(doc, np.arange(len(count) + 1))
    return doc, np.arange(len(doc)) - head[doc], start, bucket


def _pack(path: str, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in tv.slices(whole):
                ids, first = encode(b.column("text").to_pylist(), path)
                doc, piece, start, bucket = pieces(np.diff(first), longest)
                edges = np.zeros(len(doc) + 1, np.int64)
                np.cumsum(np.left_shift(1, bucket), out=edges[1:])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()).take(pa.array(doc)), *(pa.array(x.astype(np.int32)) for x in (piece, start, bucket)), tv.lists(ids.astype(np.int32), edges, pa.int32())],
                    names=["doc_id", "piece", "start", "bucket", "tokens"],
                )

    return run


def pack(docs: DataFrame, path: str = VOCABULARY, longest: int = LONGEST) -> DataFrame:
    """(doc_id, piece, start, bucket, tokens): the pieces of every document; tokens has 2**bucket ids, those from ``start`` on.

    Every token of every text is in exactly one piece. A null or empty text has
    no pieces; a text of any length has as many of the longest pieces as fit; a
    null doc_id stays null; rows that repeat a doc_id are cut one by one. Other columns, whatever their names, are not read; an empty table gives
    no rows. No shuffle takes place: ``write_buckets`` lays the pieces out by
    length.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(path, longest), "doc_id long, piece int, start int, bucket int, tokens array<int>")


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder of Parquet a bucket."""
    packed.write.partitionBy("bucket").parquet(path)
