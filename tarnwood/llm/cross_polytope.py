"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by a fast pseudo-rotation, three rounds of random signs
and a Hadamard transform, and hashed to the signed axis it is nearest to, in
large tables also to that of some coordinates of a second rotation. Each of
several tables turns anew. A query probes, in each table, the axes nearest
to it; whatever lies there is a candidate, and candidates are ranked by their
exact similarity. How many axes are probed is found on a sample of queries with
known neighbours, so that the expected recall is ``RECALL``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, prepare
from .vectors import dimensions, matrix, unit, usable

NEIGHBOURS, TABLES, RECALL, SAMPLE, SEED = 10, 4, 0.96, 256, 3
#: Vectors in a bucket, about; vectors and queries of a block.
LOAD, CELL, QUERIES = 2_000, 16_384, 16_384


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; rows are a power of two long."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def turn(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """The pseudo-rotation of one table, padded to a power of two."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, table, width])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width))
    return y


def widths(n: int, d: int, load: int = LOAD) -> tuple[int, int]:
    """Coordinates of the two polytopes of a bucket: all of the first rotation's, and of the second as many as leave about ``load`` of n vectors in a bucket; 0 where the first alone does."""
    width = 1 << max(1, (d - 1).bit_length())
    more = 0
    while n > load * 2 * width * max(1, 2 * more) and more < width:
        more = max(1, 2 * more)
    return width, more


def signed(x: np.ndarray, table: int, part: int, wide: int, seed: int = SEED) -> np.ndarray:
    """How near each row is to the signed axes of one rotation's first coordinates."""
    y = turn(x, table * 2 + part, seed)[:, :wide]
    return np.concatenate([y, -y], 1)


def bucket(x: np.ndarray, table: int, shape: tuple[int, int], seed: int = SEED) -> np.ndarray:
    """The bucket of each row: the nearest signed axis of each polytope."""
    a = signed(x, table, 0, shape[0], seed).argmax(1)
    return a * (2 * shape[1]) + signed(x, table, 1, shape[1], seed).argmax(1) if shape[1] else a


def probed(x: np.ndarray, table: int, shape: tuple[int, int], probes: int, seed: int = SEED) -> np.ndarray:
    """The ``probes`` nearest buckets of each row, by the sum over its polytopes.

    Axes are sorted within each; a sum can be among the best P only if the
    product of its axes' ranks is at most P, so no others are made.
    """
    one = signed(x, table, 0, shape[0], seed)
    first = np.argsort(-one, axis=1, kind="stable")
    if not shape[1]:
        return first[:, :probes]
    two = signed(x, table, 1, shape[1], seed)
    second = np.argsort(-two, axis=1, kind="stable")
    i, j = (v.reshape(-1) for v in np.meshgrid(np.arange(one.shape[1]), np.arange(two.shape[1]), indexing="ij"))
    able = (i + 1) * (j + 1) <= probes
    i, j = i[able], j[able]
    s = np.take_along_axis(one, first, 1)[:, i] + np.take_along_axis(two, second, 1)[:, j]
    best = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    return np.take_along_axis(first, i[best], 1) * two.shape[1] + np.take_along_axis(second, j[best], 1)


def probes_needed(q: np.ndarray, near: np.ndarray, tables: int, shape: tuple[int, int], seed: int = SEED) -> np.ndarray:
    """For each query row and its known neighbour row: how many buckets a table must probe so that one of the tables finds it."""
    best = np.full(len(q), np.iinfo(np.int64).max)
    rows = np.arange(len(q))
    for t in range(tables):
        own = bucket(near, t, shape, seed)
        one = signed(q, t, 0, shape[0], seed)
        # equally near buckets are counted too, since any of them may be probed first
        if not shape[1]:
            best = np.minimum(best, (one >= one[rows, own][:, None] - 1e-12).sum(1))
            continue
        two = signed(q, t, 1, shape[1], seed)
        level = one[rows, own // two.shape[1]] + two[rows, own % two.shape[1]] - 1e-12
        low = np.sort(two, axis=1)
        count = np.array([(two.shape[1] - np.searchsorted(low[r], level[r] - one[r])).sum() for r in rows])
        best = np.minimum(best, count)
    return best


def nearest(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest values of each row, of equal ones those of the first columns."""
    if s.shape[1] <= k:
        return np.divmod(np.arange(s.size), max(s.shape[1], 1))
    least = np.partition(s, s.shape[1] - k, axis=1)[:, -k][:, None]
    keep = s >= least
    over = np.flatnonzero(keep.sum(1) > k)
    if len(over):
        above, level = s[over] > least[over], s[over] == least[over]
        keep[over] = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True)))
    return np.nonzero(keep)


def calibrate(rows: DataFrame, d: int, k: int, tables: int, shape: tuple[int, int], recall: float, sample: int, seed: int) -> int:
    """The number of probes at which ``recall`` of the true neighbours of a sample of queries, found among all rows, are candidates."""
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("vec_id", "v").toPandas()
    ids, q = picked.vec_id.to_numpy(), unit(np.stack(picked.v.to_numpy()))
    own = rows.sparkSession.sparkContext.broadcast((ids, q))

    def top(batches):
        ids, q = own.value
        held, vecs, score = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0, d)), np.zeros((len(ids), 0))
        for b in batches:
            x, x_ids = unit(matrix(b.column("v"))), b.column("vec_id").to_numpy()
            for a in range(0, len(x), 4096):
                y, y_ids = x[a : a + 4096], x_ids[a : a + 4096]
                s = np.concatenate([score, np.where(y_ids[None] == ids[:, None], -9.0, q @ y.T)], 1)
                keep = np.argsort(-s, axis=1, kind="stable")[:, :k]
                w = score.shape[1]
                fresh = np.maximum(keep - w, 0)
                old = np.minimum(keep, max(w - 1, 0))
                is_old = keep < w
                held = np.where(is_old, np.take_along_axis(held, old, 1) if w else 0, y_ids[fresh])
                vecs = np.where(is_old[:, :, None], np.take_along_axis(vecs, old[:, :, None], 1) if w else 0, y[fresh])
                score = np.take_along_axis(s, keep, 1)
        if score.shape[1]:
            n = score.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(ids)), n)), pa.array(held.reshape(-1)), pa.array(score.reshape(-1)), pa.FixedSizeListArray.from_arrays(pa.array(vecs.reshape(-1)), d).cast(pa.list_(pa.float64()))], names=["q", "n", "s", "x"])

    found = rows.mapInArrow(top, "q long, n long, s double, x array<double>").where("s > -5")
    found = found.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "n"))).where(F.col("rn") <= k).toPandas()
    if not len(found):
        return 1
    need = np.sort(probes_needed(q[found.q.to_numpy()], np.stack(found.x.to_numpy()), tables, shape, seed))
    return int(need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)])


def _near(points: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one block of points for each of one block of queries, among the points in the buckets it probes."""
    empty = pd.DataFrame({"vec_id": [], "neighbour_id": [], "similarity": []}).astype({"vec_id": "int64", "neighbour_id": "int64"})
    if not len(points) or not len(queries):
        return empty
    order = np.lexsort((points["vec_id"].to_numpy(), points["h"].to_numpy()))
    h, ids, x = points["h"].to_numpy()[order], points["vec_id"].to_numpy()[order], unit(np.stack(points["v"].to_numpy()))[order]
    q_ids, q = queries["vec_id"].to_numpy(), unit(np.stack(queries["v"].to_numpy()))
    hs = np.concatenate(queries["hs"].to_numpy())
    who = np.repeat(np.arange(len(q)), [len(z) for z in queries["hs"]])
    by = np.argsort(hs, kind="stable")
    hs, who = hs[by], who[by]
    left, right, score = [], [], []
    for b in np.unique(h):
        lo, hi = np.searchsorted(h, b), np.searchsorted(h, b, side="right")
        asking = who[np.searchsorted(hs, b) : np.searchsorted(hs, b, side="right")]
        for a in range(0, len(asking), 1024):
            w = asking[a : a + 1024]
            for c in range(lo, hi, 8192):
                e = min(c + 8192, hi)
                # sums of products differ in their last bits between blocks, so equal vectors are ranked by id on rounded values
                s = np.round(q[w] @ x[c:e].T, 9)
                s[q_ids[w][:, None] == ids[c:e][None]] = -9
                i, j = nearest(s, k)
                left.append(w[i])
                right.append(c + j)
                score.append(s[i, j])
    if not left:
        return empty
    left, right, score = map(np.concatenate, (left, right, score))
    keep = score > -5
    left, right, score = left[keep], right[keep], score[keep]
    order = np.lexsort((ids[right], -score, left))
    left, right, score = left[order], right[order], score[order]
    keep = np.arange(len(left)) - np.searchsorted(left, left) < k
    return pd.DataFrame({"vec_id": q_ids[left[keep]], "neighbour_id": ids[right[keep]], "similarity": score[keep]})


def _stored(tables: int, cells: int, shape: tuple[int, int], seed: int, vectors: bool):
    """(cell, h, vec_id, v) of each vector in each table; without ``vectors`` the cell alone, for counts."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(matrix(b.column("v")))
            for t in range(tables):
                h = bucket(x, t, shape, seed)
                cell = pa.array(t * cells + h % cells)
                yield pa.RecordBatch.from_arrays([cell, pa.array(h), b.column("vec_id"), b.column("v")], names=["cell", "h", "vec_id", "v"]) if vectors else pa.RecordBatch.from_arrays([cell], names=["cell"])

    return run


def _asked(tables: int, cells: int, shape: tuple[int, int], probes: int, seed: int, vectors: bool):
    """(cell, hs, vec_id, v): for each query and cell the buckets to probe there."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                x = unit(matrix(b.column("v")))
                for t in range(tables):
                    p = probed(x, t, shape, probes, seed)
                    q, h = np.repeat(np.arange(len(x)), p.shape[1]), p.reshape(-1)
                    order = np.lexsort((h, h % cells, q))
                    q, h = q[order], h[order]
                    new = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (h[1:] % cells != h[:-1] % cells)])
                    cell = pa.array(t * cells + h[new] % cells)
                    if not vectors:
                        yield pa.RecordBatch.from_arrays([cell], names=["cell"])
                        continue
                    hs = pa.ListArray.from_arrays(pa.array(np.r_[new, len(q)].astype(np.int32)), pa.array(h))
                    who = pa.array(q[new])
                    yield pa.RecordBatch.from_arrays([cell, hs, b.column("vec_id").take(who), b.column("v").take(who)], names=["cell", "hs", "vec_id", "v"])

    return run


def neighbours(df: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES, recall: float = RECALL, sample: int = SAMPLE, seed: int = SEED, key: str = "vec_id", vector: str = "embedding", every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbour_id, similarity): the k nearest other vectors of each vector by cosine, as found.

    Every row whose id is divisible by ``every`` is a query, against all rows.
    Vectors of unlike length are never compared. Left out are null ids, null or
    empty vectors, and vectors with a null, NaN, infinite or only zero entries.
    Rows that repeat count once; of unlike vectors under one id the least
    counts. Similarities are rounded to 9 places, and equal ones rank by id,
    before any candidate is dropped. Fewer than k neighbours are given where
    there are fewer. Other columns, whatever their names, are not read; an empty
    table gives no rows.

    Buckets grow in number with the table, by coordinates of a second rotation.
    Candidates have no cap: a cell of many vectors or queries is split into
    blocks, each pair of which meets in a task of its own.
    """
    spark = prepare(df.sparkSession)
    rows = Scratch(spark, "polytope").keep(usable(df, key, vector), "vectors")
    # vectors move as they are in the table, and are taken to unit length where they arrive
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    out = spark.createDataFrame([], "vec_id long, neighbour_id long, similarity double")
    for d, n in dimensions(rows):
        if n < 2:
            continue
        shape, cells = widths(n, d), max(1, math.ceil(n / CELL))
        own = rows.where(F.col("d") == d)
        probes = calibrate(own, d, k, tables, shape, recall, sample, seed)
        own = own.select("vec_id", F.col("v").cast(kind).alias("v"))
        asking = own.where(F.col("vec_id") % every == 0)
        blocks = lambda made, most, name: made.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
        ps = blocks(own.mapInArrow(_stored(tables, cells, shape, seed, False), "cell long"), CELL, "ps")
        qs = blocks(asking.mapInArrow(_asked(tables, cells, shape, probes, seed, False), "cell long"), QUERIES, "qs")
        split = Scratch(spark, "polytope").keep(ps.join(qs, "cell"), "blocks")

        def dealt(made: DataFrame, one: str, other: str, split: DataFrame = split) -> DataFrame:
            """The rows with their own block number, once for each block of the other side."""
            met = made.join(split, "cell").withColumn(one[0], F.pmod(F.xxhash64("vec_id"), F.col(one)).cast("int"))
            return met.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("ps", "qs")

        points = dealt(own.mapInArrow(_stored(tables, cells, shape, seed, True), f"cell long, h long, vec_id long, v {kind}"), "ps", "qs")
        queries = dealt(asking.mapInArrow(_asked(tables, cells, shape, probes, seed, True), f"cell long, hs array<long>, vec_id long, v {kind}"), "qs", "ps")
        block = ["cell", "p", "q"]

        # two arguments alone: with a third, Spark would give the key first
        def meet(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            return _near(points, queries, k)

        out = out.unionByName(points.groupBy(*block).cogroup(queries.groupBy(*block)).applyInPandas(meet, "vec_id long, neighbour_id long, similarity double"))
    best = out.groupBy("vec_id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "similarity")
