"""Word vectors from pointwise mutual information: vocabulary, co-occurrence, shifted PPMI, eigenvectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwood.session import keep, prepare

from . import pairs


def vocabulary(rows: DataFrame, least: int = 5, most: int = 50_000) -> DataFrame:
    """(token, n): words that occur ``least`` times, the ``most`` commonest (equal counts by token)."""
    n = rows.select(F.explode("terms").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.orderBy(F.desc("n"), "token").limit(most)


def cooccurrence(rows: DataFrame, vocab: DataFrame, window: int = 5) -> DataFrame:
    """(a, b, n), a <= b: how often two vocabulary words stand at most ``window`` positions apart, either way; other words keep their places.

    Pairs are counted inside each row, of words of the vocabulary alone; the vocabulary is shared, so its size is bounded by ``vocabulary``.
    """
    # seen from both ends, a pair of unlike words counts twice; so does a pair of like ones
    return pairs.cooccurring(rows, vocab, window).withColumn("n", 2 * F.col("n"))


def ppmi(cooc: DataFrame, shift: float = 0.0) -> DataFrame:
    """(a, b, w), a <= b: ln(c_ab * D / (c_a * c_b)) - shift where positive. Off the diagonal c_ab is twice the count, which has both directions already."""
    c = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(2 * F.col("n"))
    # each end of a pair of unlike words sees half of its count
    side = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.col("n") / 2)
    full = cooc.select("a", side.alias("n")).unionByName(cooc.where("a <> b").select(F.col("b").alias("a"), (F.col("n") / 2).alias("n")))
    margin = full.groupBy("a").agg(F.sum("n").alias("c"))
    total = margin.agg(F.sum("c").alias("D"))
    one, two = margin.select("a", F.col("c").alias("ca")), margin.select(F.col("a").alias("b"), F.col("c").alias("cb"))
    w = F.log(F.col("c") * F.col("D") / (F.col("ca") * F.col("cb"))) - shift
    return cooc.withColumn("c", c).join(one, "a").join(two, "b").crossJoin(F.broadcast(total)).withColumn("w", w).where("w > 0").select("a", "b", "w")


def factorise(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, rank: int = 256, iters: int = 4, oversample: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rows U * sqrt(max(lambda, 0)), lambda, falling) of a symmetric matrix in upper-triangle form, by randomised subspace iteration."""
    rank = min(rank, n)
    if not n or not rank:
        return np.zeros((n, 0)), np.zeros(0)
    off = i != j
    rows, cols, vals = np.r_[i, j[off]], np.r_[j, i[off]], np.r_[w, w[off]]
    order = np.argsort(rows, kind="stable")
    rows, cols, vals = rows[order], cols[order], vals[order]
    head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)

    def times(x: np.ndarray) -> np.ndarray:
        out = np.zeros((n, x.shape[1]))
        for a in range(0, x.shape[1], 32):
            if len(head):
                out[rows[head], a : a + 32] = np.add.reduceat(vals[:, None] * x[cols, a : a + 32], head, axis=0)
        return out

    return subspace(times, n, rank, iters, oversample, seed)


def subspace(times: Callable[[np.ndarray], np.ndarray], n: int, rank: int, iters: int = 4, oversample: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``factorise`` of a matrix of which only its products with thin ones are known."""
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(n, rank + oversample))))[0]
    for _ in range(iters):
        q = np.linalg.qr(times(q))[0]
    values, vectors = np.linalg.eigh(q.T @ times(q))
    order = np.argsort(-values)[:rank]
    return (q @ vectors[:, order]) * np.sqrt(np.maximum(values[order], 0)), values[order]


def product(cells: DataFrame, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Products of the symmetric matrix ``cells(i, j, w)``, both triangles, sorted by i within its parts: tasks multiply their own rows, and the driver adds up one thin matrix."""
    spark = prepare(cells.sparkSession)

    def times(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                i, j, w = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                head = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                out = np.add.reduceat(w[:, None] * shared.value[j], head, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(i[head]), pa.array([r.tobytes() for r in out], pa.binary())], names=["i", "x"])

        out = np.zeros((n, x.shape[1]))
        for b in cells.select("i", "j", "w").where("w is not null").mapInArrow(run, "i int, x binary").toArrow().to_batches():
            np.add.at(out, b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(b.num_rows, -1))
        shared.unpersist()
        return out

    return times


def vectors(rows: DataFrame, rank: int = 256, window: int = 5, least: int = 5, most: int = 50_000, shift: float = 0.0, seed: int = 0) -> DataFrame:
    """(token, vec): word vectors. Cells are counted, kept and multiplied where they are; the driver holds thin matrices of at most ``most`` rows."""
    spark = rows.sparkSession
    vocab = keep(vocabulary(rows, least, most), "vocabulary")
    names = [r["token"] for r in vocab.orderBy("token").collect()]
    rank = min(rank, len(names))
    if not rank:
        return spark.createDataFrame([(t, []) for t in names], "token string, vec array<double>")
    cells = ppmi(cooccurrence(rows, vocab, window), shift)
    table = spark.createDataFrame(pa.table({"token": pa.array(names, pa.string()), "id": pa.array(np.arange(len(names), dtype=np.int32))}))
    one, two = (F.broadcast(table.select(F.col("token").alias(x), F.col("id").alias(y))) for x, y in (("a", "i"), ("b", "j")))
    half = cells.join(one, "a").join(two, "b").select("i", "j", "w")
    both = half.withColumn("ends", F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).select(F.inline("ends"), "w")
    made = keep(both.select("i", "j", "w").repartition("i").sortWithinPartitions("i", "j"), "cells")
    x, _ = subspace(product(made, len(names)), len(names), rank, seed=seed)
    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * rank), pa.array(np.ascontiguousarray(x).reshape(-1)))
    return spark.createDataFrame(pa.table({"token": pa.array(names, pa.string()), "vec": vec}))


def row(table: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, vec) of the given tokens, looked up in lower case; vec is null for unknown ones."""
    return tokens.withColumn("__t", F.lower("token")).join(table.withColumnRenamed("token", "__t"), "__t", "left").drop("__t")


def doc_vectors(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, dim, value): the sum of a document's word vectors; unknown words are skipped."""
    tf = rows.select("doc_id", F.explode("terms").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    return tf.join(table, "token").select("doc_id", "tf", F.posexplode("vec").alias("dim", "x")).groupBy("doc_id", "dim").agg(F.sum(F.col("tf") * F.col("x")).alias("value"))


def temper(table: DataFrame, alpha: float = 0.5) -> DataFrame:
    """The vectors with each coordinate divided by its deviation ** alpha; coordinates of no spread stay."""
    long_ = table.select("token", F.posexplode("vec").alias("dim", "x"))
    sd = long_.groupBy("dim").agg(F.stddev_pop("x").alias("sd"))
    scaled = long_.join(F.broadcast(sd), "dim").withColumn("x", F.when(F.col("sd") > 0, F.col("x") * F.pow("sd", F.lit(-alpha))).otherwise(F.col("x")))
    return scaled.groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))
