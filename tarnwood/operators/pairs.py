"""Counts of word pairs inside a window, made from arrays of words.

Words are numbered by a vocabulary in alphabetical order, exactly and by
Arrow's own dictionary look-up; pairs are then sums of shifted number arrays,
and only counts leave a task. Expressions on arrays would make a struct and two
strings for every pair before any of them can be dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwood.session import prepare

#: Words whose pairs are made at once.
SLICE = 200_000


def numbered(terms: pa.ListArray, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number or -1 of every word, row of every word)."""
    ids = pc.fill_null(pc.index_in(terms.flatten(), value_set=vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    return ids, np.repeat(np.arange(len(terms)), sizes)


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` words."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def within(ids: np.ndarray, row: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first number, second number, row) of the known words that stand ``distance`` apart."""
    a, b = ids[:-distance], ids[distance:]
    live = (row[:-distance] == row[distance:]) & (a >= 0) & (b >= 0)
    return a[live], b[live], row[:-distance][live]


def _local(df: DataFrame, column: str) -> pa.Array:
    """The sorted values of a column whose size the caller has bounded."""
    return pa.array(sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None), pa.string())


def cooccurring(rows: DataFrame, vocab: DataFrame, window: int) -> DataFrame:
    """(a, b, n), a <= b: how often two words of ``vocab(token)``, a table of bounded size, stand at most ``window`` positions apart."""
    spark = prepare(rows.sparkSession)
    names = _local(vocab, "token")
    shared = spark.sparkContext.broadcast(names)
    v = max(1, len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                ids, row = numbered(batch.column("terms"), shared.value)
                codes = []
                for d in range(1, window + 1):
                    a, b, _ = within(ids, row, d)
                    codes.append(np.minimum(a, b) * v + np.maximum(a, b))
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

    counts = rows.select("terms").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    table = spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(names))), "token": names})) if len(names) else spark.createDataFrame([], "id long, token string")
    one, two = (table.select(F.col("id").alias(f"i{x}"), F.col("token").alias(x)) for x in "ab")
    parts = counts.select(F.expr(f"code div {v}").alias("ia"), F.expr(f"code % {v}").alias("ib"), "n")
    return parts.join(F.broadcast(one), "ia").join(F.broadcast(two), "ib").select("a", "b", "n")


def counted(rows: DataFrame, near: DataFrame, loose: DataFrame, window: int) -> DataFrame:
    """(leg, term, doc_id, tf) of the wanted pairs in each document: ``near(term)`` of neighbours in their order, ``loose(term)`` of words at most ``window`` apart in alphabetical order.

    A pair is two words with a space between them. Pairs are those of a query
    set, whose size the caller has checked.
    """
    spark = prepare(rows.sparkSession)
    wanted = [_local(df, "term") for df in (near, loose)]
    vocab = pa.array(sorted({w for x in wanted for p in x.to_pylist() for w in p.split(" ")}), pa.string())
    v = max(1, len(vocab))
    at = {w: i for i, w in enumerate(vocab.to_pylist())}
    code = [np.array([at[a] * v + at[b] for a, b in (p.split(" ") for p in x.to_pylist())], np.int64) for x in wanted]
    order = [np.argsort(c) for c in code]
    shared = spark.sparkContext.broadcast((vocab, [c[o] for c, o in zip(code, order)], [x.take(pa.array(o)) for x, o in zip(wanted, order)]))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, codes, names = shared.value
        for whole in batches:
            for batch in slices(whole):
                ids, row = numbered(batch.column("terms"), vocab)
                for leg, far in ((0, 1), (1, window)):
                    if not len(codes[leg]):
                        continue
                    found = []
                    for d in range(1, far + 1):
                        a, b, r = within(ids, row, d)
                        c = a * v + b if not leg else np.minimum(a, b) * v + np.maximum(a, b)
                        k = np.minimum(np.searchsorted(codes[leg], c), len(codes[leg]) - 1)
                        hit = codes[leg][k] == c
                        found.append(r[hit] * len(codes[leg]) + k[hit])
                    both, n = np.unique(np.concatenate(found), return_counts=True)
                    r, k = np.divmod(both, len(codes[leg]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), leg, np.int32)), names[leg].take(pa.array(k)), batch.column("doc_id").take(pa.array(r)), pa.array(n.astype(np.int64))], names=["leg", "term", "doc_id", "tf"])

    found = rows.select("doc_id", "terms").mapInArrow(run, f"leg int, term string, doc_id {kind}, tf long")
    # rows that repeat a doc_id count together
    return found.groupBy("leg", "term", "doc_id").agg(F.sum("tf").alias("tf"))
