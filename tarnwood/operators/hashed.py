"""SplitMix64 n-gram hashes as a relation, for sketches and minima by plain aggregation.

Each distinct (document, n-gram) is hashed once, in Arrow batches; hashes are
given as two halves, since a 64-bit unsigned number doesn't fit BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwood.functions import hashing as H
from tarnwood.session import prepare

from . import embed, pairs, scan


def gram_hashes(docs: DataFrame, least: int = 3, most: int = 5, seed: int = 0, family: str = "splitmix64") -> DataFrame:
    """(doc_id, high, low, n): the halves of the hash of each distinct byte n-gram of a document, and how often it occurs."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b, found = whole.slice(at, 200), []
                for t in b.column(1).to_pylist():
                    buf = np.frombuffer((t or "").encode(), np.uint8)
                    found.append(np.unique(np.concatenate([H.window_hashes(buf, g, seed, family) for g in range(least, most + 1)]), return_counts=True))
                h, n = (np.concatenate(x) for x in zip(*found))
                ids = b.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x, _ in found])))
                yield pa.RecordBatch.from_arrays([ids, pa.array((h >> np.uint64(32)).astype(np.int64)), pa.array((h & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["doc_id", "high", "low", "n"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, high long, low long, n long")


def per_document(docs: DataFrame, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], schema: tuple[str, str], least: int = 3, most: int = 5, seed: int = 0, family: str = "splitmix64") -> DataFrame:
    """(doc_id, two columns of longs): what ``make`` gives of the hashes of all byte n-grams of each row, where the row is."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b, found = whole.slice(at, 200), []
                for t in b.column(1).to_pylist():
                    buf = np.frombuffer((t or "").encode(), np.uint8)
                    found.append(make(np.concatenate([H.window_hashes(buf, g, seed, family) for g in range(least, most + 1)])))
                key, value = (np.concatenate(x) for x in zip(*found))
                ids = b.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x, _ in found])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(key.astype(np.int64)), pa.array(value.astype(np.int64))], names=["doc_id", *schema])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema[0]} long, {schema[1]} long")


def sketch(docs: DataFrame, dim: int) -> DataFrame:
    """(doc_id, bucket, value) of the count sketch, buckets of 0 left out; rows that repeat a doc_id add up."""

    def make(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.bincount(((h & np.uint64(0xFFFFFFFF)) % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), -2, 2), dim)
        at = np.flatnonzero(out)
        return at, out[at]

    per = per_document(docs, make, ("bucket", "value"))
    return per if scan.unique_ids(docs) else per.groupBy("doc_id", "bucket").agg(F.sum("value").alias("value")).where("value <> 0")


def bin_minima(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, bin, least): the least high half by the hash modulo k, a power of two; of rows that repeat a doc_id the least of all."""
    if k & (k - 1):
        raise ValueError("k must be a power of two here")

    def make(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.full(k, np.iinfo(np.int64).max)
        np.minimum.at(out, (h % np.uint64(k)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64))
        at = np.flatnonzero(out < np.iinfo(np.int64).max)
        return at, out[at]

    per = per_document(docs, make, ("bin", "least"))
    return per if scan.unique_ids(docs) else per.groupBy("doc_id", "bin").agg(F.min("least").alias("least"))


def bucket_weights(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, df, w_q10) of every bucket, also those of no document; the counts come from ``embed.learn_idf``'s rule. Each task counts its own documents; where ids repeat, pairs of document and bucket are made distinct."""
    spark = docs.sparkSession
    if scan.unique_ids(docs):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df = np.zeros(buckets, np.int64)
            for b in batches:
                for t in b.column(0).to_pylist():
                    buf = np.frombuffer((t or "").encode(), np.uint8)
                    h = np.concatenate([H.window_hashes(buf, g) for g in range(3, 6)])
                    df[np.unique(((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64))] += 1
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["bucket", "df"])

        prepare(spark)
        per = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    else:
        per = gram_hashes(docs).select("doc_id", (F.col("low") % buckets).alias("bucket")).distinct().groupBy("bucket").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    every = spark.range(buckets).withColumnRenamed("id", "bucket").join(per, "bucket", "left").fillna(0, ["df"]).crossJoin(F.broadcast(n))
    w = F.floor(1024 * F.log((F.col("n") + 1) / (F.col("df") + 0.5)) + 0.5)
    return every.select("bucket", "df", F.greatest(F.lit(0), F.least(F.lit(65_535), w)).cast("long").alias("w_q10"))


#: Distinct n-grams a task holds before it hands their counts on.
MOST_GRAMS = 2_000_000


def gram_counts(docs: DataFrame, bounded: bool, least: int = 3, most: int = 5) -> DataFrame:
    """(gram, docs, n): in how many documents each byte n-gram occurs, and how often; n-grams as upper-case hex.

    ``bounded`` ones are those of each word written as <word>. Documents have
    ids of their own; counts are added up in the task before they are shuffled.
    """
    prepare(docs.sparkSession)

    def codes(text: bytes) -> np.ndarray:
        tokens = embed.BOUNDED.findall(text) if bounded else []
        found = []
        for k in range(least, most + 1):
            buf = np.frombuffer(text, np.uint8)
            if bounded:
                buf, at, _ = embed.bounded_windows(tokens, k)
            if len(buf) < k:
                continue
            code = np.full(len(buf) - k + 1, k, np.int64)
            for i in range(k):
                code = (code << 8) | buf[i : len(buf) - k + 1 + i]
            found.append((code[at] if bounded else code) - (k << 8 * k) + (k << 8 * most))
        return np.concatenate([*found, np.zeros(0, np.int64)])

    def merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return code, *(np.bincount(at, np.concatenate([p[i] for p in parts]), len(code)).astype(np.int64) for i in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, size = None, [], 0
        rows = (t for b in batches for t in b.column(0).to_pylist())

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["code", "docs", "n"])

        for t in rows:
            code, n = np.unique(codes((t or "").encode()), return_counts=True)
            parts.append((code, np.ones(len(code), np.int64), n))
            size += len(code)
            if size > MOST_GRAMS:
                held = merged(([held] if held is not None else []) + parts)
                parts, size = [], 0
                if len(held[0]) > MOST_GRAMS:
                    yield out()
                    held = None
        if parts:
            held = merged(([held] if held is not None else []) + parts)
        if held is not None:
            yield out()

    per = docs.select(F.col("text").cast("string")).mapInArrow(run, "code long, docs long, n long").groupBy("code").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    size = F.shiftright("code", 8 * most)
    body = F.col("code") - F.shiftleft(size, 8 * most)
    return per.select(F.lpad(F.hex(body), size.cast("int") * 2, F.lit("0")).alias("gram"), "docs", "n")


def unordered_pairs(rows: DataFrame, window: int = 8) -> DataFrame:
    """(doc_id, pairs, dl) of ``rows(doc_id, terms)`` with ids of their own: the distinct unordered pairs of words at most ``window`` apart, and how many there are with repeats; no row without any."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pairs.slices(whole):
                flat = b.column("terms").flatten().dictionary_encode()
                key, v = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(flat.dictionary))
                row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(b.column("terms")), 0).to_numpy(zero_copy_only=False))
                found = []
                for d in range(1, window + 1):
                    x, y, r = pairs.within(key, row, d)
                    found.append(np.stack([r, np.minimum(x, y) * v + np.maximum(x, y)]))
                r, code = np.concatenate(found, axis=1)
                dl = np.bincount(r, minlength=b.num_rows)
                order = np.lexsort((code, r))
                r, code = r[order], code[order]
                first = np.r_[True, (r[1:] != r[:-1]) | (code[1:] != code[:-1])] if len(r) else np.zeros(0, bool)
                n = np.bincount(r[first], minlength=b.num_rows)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array(n[at]), pa.array(dl[at])], names=["doc_id", "pairs", "dl"])

    return rows.select("doc_id", "terms").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pairs long, dl long")


def word_hashes(terms: DataFrame, family: str, seed: int = 0) -> DataFrame:
    """(term, high, low): the halves of each term's hash under one of the families."""
    prepare(terms.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = H.hash64([t.encode() for t in b.column(0).to_pylist()], seed, family)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((h >> np.uint64(32)).astype(np.int64)), pa.array((h & np.uint64(0xFFFFFFFF)).astype(np.int64))], names=["term", "high", "low"])

    return terms.select("term").where("term is not null").mapInArrow(run, "term string, high long, low long")
