"""Quality classification by importance resampling.

Two generative models of hashed unigrams and bigrams, one of target text and
one of all the raw text, give each document the log of its importance weight,
the ratio of its probabilities under the two. A sample of k documents without
replacement, by weight, is then the top k of log weight + Gumbel noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import Scratch, prepare

BUCKETS, PRIOR, MAX_TARGET_DOCS, SEED = 1 << 16, 5.0, 50_000, 7
U = np.uint64


def features(column, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, first): hashed unigrams, then bigrams, of each text; tokens are runs of word bytes or of other signs, not folded.

    Bucket 0 is kept for a token that repeats the one before it. Position i of
    ``bucket`` holds token i's unigram, and position n + i the bigram of tokens
    i and i + 1, or -1 where i is the last token of its document.
    """
    buf, off = tv.bytes_of(column)
    starts, ends, first = tv.runs(tv.CLASS[buf], off)
    h = tv.hashes(buf, starts, ends)
    n = len(h)
    out = np.full(2 * n, -1, np.int64)
    out[:n] = 1 + (h % U(buckets - 1)).astype(np.int64)
    if n > 1:
        two = 1 + (tv.mix(h[:-1] * U(3) + h[1:]) % U(buckets - 1)).astype(np.int64)
        two[h[:-1] == h[1:]] = 0
        two[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < n)] - 1] = -1
        out[n : 2 * n - 1] = two
    return out, first


def gumbel(ids: pa.Array, seed: int) -> np.ndarray:
    """Standard Gumbel noise that depends on the id and the seed alone."""
    x = pc.fill_null(ids, -(1 << 62)).to_numpy(zero_copy_only=False).view(U)
    u = ((tv.mix(x * U(0x9E3779B97F4A7C15) + U(seed)) >> U(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for whole in batches:
            for b in tv.slices(whole):
                f, first = features(b.column("text"), buckets)
                live = f >= 0
                raw += np.bincount(f[live], minlength=buckets)
                hit = np.repeat(b.column("is_target").to_numpy(zero_copy_only=False), np.diff(first))
                both = np.r_[hit, hit] & live
                target += np.bincount(f[both], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    return run


def log_ratios(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> np.ndarray:
    """The log ratio of target to raw probability of each bucket; counts cover all of docs.

    Both models have ``prior`` added to each bucket's count at the target's scale.
    """
    ids = target_ids.select(F.col("doc_id").alias("__t")).distinct()
    marked = docs.join(F.broadcast(ids), docs["doc_id"] == F.col("__t"), "left").select("text", F.col("__t").isNotNull().alias("is_target"))
    rows = marked.mapInArrow(_count(buckets), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[rows.bucket], target[rows.bucket] = rows.raw, rows.target
    if not target.sum():
        return np.zeros(buckets)
    return np.log(target + prior) - np.log(raw * (target.sum() / raw.sum()) + prior)


def weights(column, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log weight, tokens) of each text."""
    f, first = features(column, len(ratio))
    n = len(f) // 2
    each = np.where(f >= 0, ratio[np.maximum(f, 0)], 0.0)
    per = each[:n] + each[n:]
    count = np.diff(first)
    out = np.zeros(len(count))
    full = count > 0
    if full.any():
        out[full] = np.add.reduceat(per, first[:-1][full])
    return out, count


def _score(ratio, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in tv.slices(whole):
                w, n = weights(b.column("text"), ratio.value)
                w, n = pa.array(w), pa.array(n.astype(np.int64))
                key = pc.add(w, pa.array(gumbel(b.column("doc_id").cast(pa.int64()), seed)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), n, w, key], names=["doc_id", "n_tokens", "log_weight", "key"])

    return run


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest value of column ``key``, found by counting in ever narrower bins."""
    if k <= 0:
        return math.inf
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k >= n:
        return -math.inf
    above = 0
    while True:
        width = (hi - lo) / bins
        inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
        if width <= 0 or lo + width == lo:
            return lo
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("key") - lo) / width)).cast("int")
        found = inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("bin")).collect()
        for r in found:
            if above + r["n"] >= k:
                break
            above += r["n"]
        lo, hi = r["lo"], r["hi"]
        if lo == hi or (r["n"] == 1):
            return lo
        if above + 1 == k:
            return hi


def target_labels(labels: DataFrame, most: int = MAX_TARGET_DOCS) -> DataFrame:
    """The ids of documents labelled as good and not toxic: all of them up to ``most``, else those with the least hashes."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _sampled(docs: DataFrame, labels: DataFrame, seed: int, buckets: int, prior: float, most: int):
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ratio = spark.sparkContext.broadcast(log_ratios(docs, target_labels(labels, most), buckets, prior))
    scored = Scratch(spark, "importance").keep(docs.mapInArrow(_score(ratio, seed), "doc_id long, n_tokens long, log_weight double, key double"), "scores")
    live = scored.where("n_tokens > 0")
    marks = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    good, known = marks.join(live.select("doc_id"), "doc_id", "left_semi").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)), F.count("*")).first()
    n = live.count()
    k = math.ceil(n * (good / known)) if known else n
    return ratio, scored, kth_largest(live, k)


def resample(docs: DataFrame, labels: DataFrame, seed: int = SEED, buckets: int = BUCKETS, prior: float = PRIOR, most: int = MAX_TARGET_DOCS) -> DataFrame:
    """(doc_id, n_tokens, log_weight): the sampled documents.

    ``labels(doc_id, quality, toxic)`` marks some documents. The target model
    comes from those with quality 1 and toxic not 1, ``most`` of them at most
    (those with the least hashes); the raw model from all documents. k is the
    number of documents with a token times the share of quality 1 among the
    labelled ones. A null, empty or blank text is never sampled. A null doc_id
    is a document without a label and shares one noise value; ties at the k-th
    key are all kept; rows that repeat a doc_id are judged one by one; a text of
    any length is counted and weighed whole. Without a
    usable label all documents with a token are kept. Other columns, whatever
    their names, are not read; an empty table gives no rows.
    """
    _, scored, least = _sampled(docs, labels, seed, buckets, prior, most)
    return scored.where((F.col("n_tokens") > 0) & (F.col("key") >= least)).select("doc_id", "n_tokens", "log_weight")


def _filter(ratio, seed: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in tv.slices(whole):
                w, n = weights(b.column("text"), ratio.value)
                yield b.filter(pa.array((n > 0) & (w + gumbel(b.column("doc_id").cast(pa.int64()), seed) >= least)))

    return run


def keep_sampled(docs: DataFrame, labels: DataFrame, seed: int = SEED, buckets: int = BUCKETS, prior: float = PRIOR, most: int = MAX_TARGET_DOCS) -> DataFrame:
    """The sampled rows of docs, with all their columns; scores are computed again, which costs less than a shuffle of the texts.

    Nulls, ties, repeats, long and empty texts are treated as ``resample`` says;
    an empty table stays empty.
    """
    ratio, _, least = _sampled(docs, labels, seed, buckets, prior, most)
    return docs.mapInArrow(_filter(ratio, seed, least), docs.schema)
