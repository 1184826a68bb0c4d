"""Product quantisation: codebooks by k-means a subspace, codes, and scores by lookup tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.functions import hashing as H
from tarnwood.session import prepare

U = np.uint64
ROUNDS = 25


def check(dim: int, m: int, k: int) -> int:
    """The length of a subvector."""
    if m < 1 or dim % m or not 1 <= k <= 256:
        raise ValueError("m must divide the dimension, and k be in 1 to 256")
    return dim // m


def random_codebooks(dim: int, m: int, k: int, seed: int = 0) -> np.ndarray:
    """(m, k, dim / m) Gaussian centroids, each keyed by its place."""
    d = check(dim, m, k)
    key = np.arange(m * k * d, dtype=U).reshape(m, k, d)
    h0 = H.mix(key ^ U(seed))
    h1 = H.mix(h0 ^ H.GOLDEN)
    u0, u1 = ((x >> U(11) | U(1)).astype(np.float64) / 2.0**53 for x in (h0, h1))
    return np.sqrt(-2 * np.log(u0)) * np.cos(2 * np.pi * u1)


def _far(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances of rows (n, m, d) to all centroids (m, k, d), as (n, m, k)."""
    d = np.stack([(c * c).sum(1)[None] - 2 * x[:, i] @ c.T for i, c in enumerate(books)], 1)
    return np.maximum(d + (x * x).sum(2)[:, :, None], 0)


def _parts(batches, m: int, most: int = 4096):
    """(h, x) of slices of the rows: the hashes of their keys and their subvectors (n, m, d)."""
    for whole in batches:
        for at in range(0, whole.num_rows, most):
            b = whole.slice(at, most)
            x = b.column("x").flatten().to_numpy(zero_copy_only=False)
            yield b.column("h").to_numpy().view(U), x.reshape(b.num_rows, m, -1)


def _picked(rows: DataFrame, books: np.ndarray, many: np.ndarray, score) -> dict[int, np.ndarray]:
    """For each subspace the ``many`` subvectors off all centroids with the least ``score(h, distance, subspace)``, over all rows."""
    m, _, d = books.shape

    def run(batches):
        best = [(np.zeros(0), np.zeros((0, d)))] * m
        for h, x in _parts(batches, m):
            near = _far(x, books).min(2)
            for i in np.flatnonzero(many):
                live = near[:, i] > 1e-12
                s, v = np.r_[best[i][0], score(h[live], near[live, i], i)], np.r_[best[i][1], x[live, i]]
                keep = np.argsort(s, kind="stable")[: many[i]]
                best[i] = s[keep], v[keep]
        for i, (s, v) in enumerate(best):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int32)), pa.array(s), pa.array(list(v), pa.list_(pa.float64()))], names=["mi", "s", "v"])

    rank = F.row_number().over(Window.partitionBy("mi").orderBy("s", "v"))
    out: dict[int, list] = {}
    for r in rows.mapInArrow(run, "mi int, s double, v array<double>").withColumn("rn", rank).where(F.col("rn") <= int(many.max())).orderBy("mi", "rn").collect():
        out.setdefault(r["mi"], []).append(r["v"])
    return {i: np.array(v)[: many[i]] for i, v in out.items()}


def _seeds(rows: DataFrame, start: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ from ``start``: each next centroid is drawn from all rows by squared distance, as the first in a race of exponential times keyed by row."""
    books, m = start, len(start)
    for step in range(1, k):

        def time(h, near, i, step=step):
            u = (H.mix(h ^ H.mix(np.array([(seed * 256 + step) * m + i], U))) >> U(11) | U(1)).astype(np.float64) / 2.0**53
            return -np.log(u) / near

        found = _picked(rows, books, np.ones(m, np.int64), time)
        # where all rows lie on centroids, the first is repeated
        books = np.concatenate([books, np.stack([found[i][:1] if i in found else books[i, :1] for i in range(m)])], 1)
    return books


def _lloyd(rows: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, rows) of the subvectors nearest to each centroid, added up over all rows in Spark."""
    m, k, d = books.shape

    def run(batches):
        total = np.zeros((m, k, d + 1))
        for _, x in _parts(batches, m):
            own = _far(x, books).argmin(2)
            for i in range(m):
                total[i, :, d] += np.bincount(own[:, i], minlength=k)
                for j in range(d):
                    total[i, :, j] += np.bincount(own[:, i], x[:, i, j], k)
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "s"])

    out = np.zeros(m * k * (d + 1))
    for r in rows.mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        out[r["cell"]] = r["s"]
    out = out.reshape(m, k, d + 1)
    return out[:, :, :d], out[:, :, d]


def train(vectors: DataFrame, m: int, k: int = 256, seed: int = 0, vec: str = "vec", key: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """(mi, ki, centroid): k-means of each subspace on all vectors.

    k-means++ from the row of the least key, then Lloyd's rounds, each a pass
    over all vectors; an empty cluster takes the row farthest from its centroid.
    """
    spark = prepare(vectors.sparkSession)
    first = vectors.orderBy(key, vec).select(vec).first()
    if first is None:
        raise ValueError("no vectors to train on")
    d = check(len(first[0]), m, k)
    rows = vectors.select(F.xxhash64(key, F.lit(seed)).alias("h"), F.col(vec).cast("array<double>").alias("x")).persist(StorageLevel.DISK_ONLY)
    try:
        if rows.count() < k:
            raise ValueError("fewer rows than centroids")
        books = _seeds(rows, np.array(first[0], np.float64).reshape(m, 1, d), k, seed)
        for _ in range(rounds):
            sums, n = _lloyd(rows, books)
            new = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1)[:, :, None], books)
            empty = (n == 0).sum(1)
            if empty.any():
                for i, v in _picked(rows, books, empty, lambda h, near, i: -near).items():
                    new[i, np.flatnonzero(n[i] == 0)[: len(v)]] = v
            still = np.abs(new - books).max() <= 1e-12 * max(1.0, np.abs(books).max())
            books = new
            if still:
                break
    finally:
        rows.unpersist()
    return table_of(spark, books)


def codebooks(table: DataFrame) -> np.ndarray:
    """The table as an array of (m, k, d): m * k rows, 256 m at most."""
    rows = table.orderBy("mi", "ki").collect()
    m = 1 + max(r["mi"] for r in rows)
    return np.array([r["centroid"] for r in rows], np.float64).reshape(m, len(rows) // m, -1)


def table_of(spark, books: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, j, [float(v) for v in books[i, j]]) for i in range(books.shape[0]) for j in range(books.shape[1])], "mi int, ki int, centroid array<double>")


def encode(vectors: DataFrame, table: DataFrame, vec: str = "vec", key: str = "doc_id") -> DataFrame:
    """(key, code array<int>): the nearest centroid in each subspace, the first of equals. Built-in expressions only."""
    books = codebooks(table)
    m, _, d = books.shape
    flat = F.array(*[F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in b]) for b in books]) if books.size <= 4096 else None
    if flat is None:
        return _encode_arrow(vectors, books, vec, key)
    x = F.transform(vec, lambda v: v.cast("double"))

    def nearest(i: Column) -> Column:
        part = F.slice(x, i * d + 1, F.lit(d))
        far = F.transform(F.element_at(flat, i + 1), lambda c: F.round(F.aggregate(F.zip_with(part, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y), 9))
        return (F.array_position(far, F.array_min(far)) - 1).cast("int")

    return vectors.select(key, F.transform(F.sequence(F.lit(0), F.lit(m - 1)), nearest).alias("code"))


def nearest_codes(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    m, _, d = books.shape
    out = np.empty((len(x), m), np.int32)
    for i in range(m):
        b = books[i]
        out[:, i] = ((b * b).sum(1)[None] - 2 * x[:, i * d : (i + 1) * d] @ b.T).argmin(1)
    return out


def _encode_arrow(vectors: DataFrame, books: np.ndarray, vec: str, key: str) -> DataFrame:
    spark = prepare(vectors.sparkSession)
    shared = spark.sparkContext.broadcast(books)

    def run(batches):
        for b in batches:
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64) if b.num_rows else np.zeros((0, books.shape[0] * books.shape[2]))
            code = nearest_codes(x, shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype=np.int32) * code.shape[1]), pa.array(code.reshape(-1)))], names=[key, "code"])

    return vectors.select(key, vec).mapInArrow(run, f"{key} {vectors.schema[key].dataType.simpleString()}, code array<int>")


def decode(codes: DataFrame, table: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, vec): the centroids of a code, one after another."""
    parts = codes.select(key, F.posexplode("code").alias("mi", "ki")).join(table, ["mi", "ki"])
    return parts.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("mi", "centroid"))), lambda s: s["centroid"])).alias("vec"))


def lookup(queries: DataFrame, table: DataFrame, vec: str = "vec", query: str = "query_id") -> DataFrame:
    """(query_id, l2, ip): for each query the tables of squared distances and inner products to all centroids, subspace by subspace."""
    books = table.groupBy("mi").agg(F.transform(F.array_sort(F.collect_list(F.struct("ki", "centroid"))), lambda s: s["centroid"]).alias("cs"))
    part = F.slice(F.transform(vec, lambda v: v.cast("double")), F.col("mi") * F.size(F.col("cs")[0]) + 1, F.size(F.col("cs")[0]))
    fold = lambda f: F.transform("cs", lambda c: F.aggregate(F.zip_with(F.col("part"), c, f), F.lit(0.0), lambda s, y: s + y))
    each = queries.crossJoin(F.broadcast(books)).withColumn("part", part).select(query, "mi", fold(lambda a, b: (a - b) * (a - b)).alias("l2"), fold(lambda a, b: a * b).alias("ip"))
    rows = F.array_sort(F.collect_list(F.struct("mi", "l2", "ip")))
    return each.groupBy(query).agg(rows.alias("rows")).select(query, F.transform("rows", lambda r: r["l2"]).alias("l2"), F.transform("rows", lambda r: r["ip"]).alias("ip"))


def adc(codes: DataFrame, tables: DataFrame, metrics: tuple[str, ...] = ("l2", "ip"), key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """(query_id, key, l2, ip): asymmetric scores of all codes; with ``metrics=("ip",)`` half the tables travel."""
    met = codes.crossJoin(tables.select(query, *metrics))
    score = lambda t: F.aggregate(F.zip_with("code", t, lambda c, row: F.element_at(row, c + 1)), F.lit(0.0), lambda s, y: s + y)
    return met.select(query, key, *[score(m).alias(m) for m in metrics])
