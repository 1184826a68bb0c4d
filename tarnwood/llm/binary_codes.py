"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector x is rotated at random and coded by the signs of its coordinates,
a corner c of the unit cube; <c, x> is stored beside it. For a vector y,
<c, y> / <c, x> is an unbiased estimate of <x, y> whose error is bounded, with a
confidence set by ``EPSILON``, by sqrt(1 - <x, y>**2) * sqrt(1 - <c, x>**2) /
<c, x> * EPSILON / sqrt(d - 1). Several rotations, whose estimates are averaged,
tighten the bound. Pairs whose interval lies on one side of the threshold are
decided by it; the others are computed exactly. Bands of code bits are the
buckets in which pairs meet; only ids meet there, and vectors are fetched for
pairs alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .runtime import Scratch, prepare
from .textvec import mix
from .vectors import dimensions, matrix, unit, usable

THRESHOLD, BANDS, EPSILON, SEED, TILE = 0.95, 24, 4.0, 5, 512
#: Share of the pairs at the threshold that meet, at least, with bands taken as independent; somewhat above the 0.9 that is asked for.
RECALL = 0.93
#: Words of the code by which pairs of a bucket are told apart before they leave the join.
WORDS = 4
U = np.uint64


def rotations(d: int, many: int, seed: int = SEED) -> np.ndarray:
    """``many`` random orthogonal matrices of size d."""
    rng = np.random.default_rng([seed, d])
    out = []
    for _ in range(many):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def code(x: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated, signs, factor) of unit vectors, each with an axis for the rotations."""
    y = np.einsum("rij,nj->nri", turns, x)
    sign = np.where(y >= 0, 1, -1).astype(np.int8)
    return y, sign, np.abs(y).sum(2) / math.sqrt(x.shape[1])


def plan(n: int, d: int, threshold: float = THRESHOLD, bands: int = BANDS, recall: float = RECALL) -> tuple[int, int, int]:
    """(bits of a band, bands, rotations): bands narrow enough that unlike vectors seldom meet among n, and ``bands`` or as many more as ``recall`` needs."""
    bits = max(6, min(60, math.ceil(math.log2(max(n, 2))) + 2))
    # a bit of two vectors is equal with a probability of 1 - angle / pi
    equal = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    if 0 < equal < 1:
        bands = max(bands, math.ceil(math.log(1 - recall) / math.log1p(-equal)))
    return bits, bands, max(2, math.ceil(bands * bits / d))


def band_keys(sign: np.ndarray, bits: int, bands: int = BANDS) -> np.ndarray:
    """The key of each band: a hash of its number and its bits."""
    flat = sign.reshape(len(sign), -1)[:, : bits * bands] > 0
    flat = flat.reshape(len(sign), -1, bits)[:, :bands]
    value = (flat.astype(np.int64) << np.arange(bits)).sum(2)
    return mix(value.view(U) ^ mix(np.arange(flat.shape[1], dtype=U))).view(np.int64)


def estimate(rotated: np.ndarray, sign: np.ndarray, factor: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, bounds) of the inner products of all rows of ``rotated`` with all coded vectors."""
    d, r = rotated.shape[2], rotated.shape[1]
    est, var = np.zeros((len(rotated), len(sign))), np.zeros((1, len(sign)))
    for k in range(r):
        est += rotated[:, k] @ (sign[:, k].T / math.sqrt(d)) / factor[:, k]
        var += (1 - np.minimum(factor[:, k], 1) ** 2) / factor[:, k] ** 2
    est /= r
    # a wider sine is taken than the estimate's own, so that an estimate that is too high doesn't narrow its bound
    spread = np.sqrt(var) / r * epsilon / math.sqrt(max(d - 1, 1))
    low = np.clip(np.abs(est) - spread, 0, 1)
    return est, np.sqrt(1 - low**2) * spread


def estimate_pairs(rotated: np.ndarray, sign: np.ndarray, factor: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, bounds) of the inner products of each row of ``rotated`` with the coded vector of the same row."""
    d, r = rotated.shape[2], rotated.shape[1]
    est = ((rotated * sign).sum(2) / math.sqrt(d) / factor).mean(1)
    var = ((1 - np.minimum(factor, 1) ** 2) / factor**2).sum(1)
    spread = np.sqrt(var) / r * epsilon / math.sqrt(max(d - 1, 1))
    low = np.clip(np.abs(est) - spread, 0, 1)
    return est, np.sqrt(1 - low**2) * spread


def farthest(bits: int, threshold: float) -> int:
    """A Hamming distance of ``bits`` signs that pairs at the threshold stay below by six deviations."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.floor(bits * p + 6 * math.sqrt(bits * p * (1 - p)) + 1)


CODES = "vec_id long, keys array<long>, words array<long>, code binary, factor array<double>"


def _codes(d: int, bits: int, wide: int, many: int, seed: int):
    """A vector's band keys, the first ``WORDS`` words of its code, the whole code and its correction factors."""

    def run(batches):
        turns = rotations(d, many, seed)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                _, sign, factor = code(unit(matrix(part.column("v"))), turns)
                flat = np.packbits(sign.reshape(len(sign), -1) > 0, axis=1)
                head = np.zeros((len(flat), WORDS * 8), np.uint8)
                head[:, : min(flat.shape[1], WORDS * 8)] = flat[:, : WORDS * 8]
                rows = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1), kind))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), rows(band_keys(sign, bits, wide), pa.int64()), rows(head.view(np.int64), pa.int64()), pa.array([x.tobytes() for x in flat], pa.binary()), rows(factor, pa.float64())],
                    names=["vec_id", "keys", "words", "code", "factor"],
                )

    return run


def _judged(d: int, many: int, seed: int, threshold: float):
    """(a, b, sure): the pairs that their estimates don't rule out, and whether they decide them."""

    def run(batches):
        turns = rotations(d, many, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                b = whole.slice(at, TILE)
                rotated = np.einsum("rij,nj->nri", turns, unit(matrix(b.column("v"))))
                raw = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                sign = np.unpackbits(raw, axis=1)[:, : many * d].reshape(-1, many, d).astype(np.float64) * 2 - 1
                est, bound = estimate_pairs(rotated, sign, matrix(b.column("factor")))
                keep = est + bound >= threshold
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(est - bound >= threshold)], names=["a", "b", "sure"]).filter(pa.array(keep))

    return run


def _exact(threshold: float):
    def run(batches):
        for b in batches:
            x, y = (unit(matrix(b.column(n))) if b.num_rows else np.zeros((0, 1)) for n in ("v", "w"))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(np.einsum("ij,ij->i", x, y) >= threshold))

    return run


def linked(pairs: DataFrame, rows: DataFrame, codes: DataFrame, d: int, many: int, seed: int, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) at or above the threshold: by their estimates where these decide, else computed exactly."""
    first = pairs.join(rows.select(F.col("vec_id").alias("a"), "v").hint("merge"), "a")
    met = first.join(codes.select(F.col("vec_id").alias("b"), "code", "factor").hint("merge"), "b")
    judged = scratch.keep(met.select("a", "b", "v", "code", "factor").mapInArrow(_judged(d, many, seed, threshold), "a long, b long, sure boolean"), f"{name}-judged")
    open_ = judged.where("not sure").join(rows.select(F.col("vec_id").alias("a"), "v").hint("merge"), "a").join(rows.select(F.col("vec_id").alias("b"), F.col("v").alias("w")).hint("merge"), "b")
    exact = open_.select("a", "b", "v", "w").mapInArrow(_exact(threshold), "a long, b long")
    return scratch.keep(judged.where("sure").select("a", "b").unionByName(exact), name)


def near_groups(df: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, keep_id): each vector in a group with another, and the least id of the group.

    Groups are the connected components of the pairs with a cosine similarity
    of at least ``threshold``; vectors of unlike length are never paired. Left
    out are null ids, null or empty vectors, and vectors with a null, NaN,
    infinite or only zero entries. Rows that repeat count once; of unlike
    vectors under one id the least counts. Equal vectors are a pair. Other
    columns, whatever their names, are not read; an empty table gives no rows.
    The search is approximate: two vectors meet if one band of their codes is
    equal. There are ``bands`` of them, or as many more as let pairs at the
    threshold meet with a probability of ``RECALL`` among so many vectors.

    Only ids and band keys are shuffled to find the buckets. All members of a
    bucket are paired with its first, so a bucket of copies costs their number;
    where that leaves a bucket in more than one component, pairs across the
    components are made of the members whose codes are near enough. Vectors and
    codes are fetched for pairs alone.
    """
    spark = prepare(df.sparkSession)
    scratch = Scratch(spark, "codes")
    rows = scratch.keep(usable(df, key, vector), "vectors")
    edges, used = spark.createDataFrame([], "a long, b long"), []
    for d, n in dimensions(rows):
        bits, wide, many = plan(n, d, threshold, bands)
        own = rows.where(F.col("d") == d)
        codes = scratch.keep(own.mapInArrow(_codes(d, bits, wide, many, seed), CODES), "codes")
        cells = codes.select("vec_id", F.explode("keys").alias("k"))
        heads = cells.groupBy("k").agg(F.min("vec_id").alias("head"), F.max("vec_id").alias("last")).where("head <> last").select("k", "head")
        members = scratch.keep(cells.join(heads.hint("merge"), "k"), "members")
        first = members.where("vec_id <> head").select(F.col("head").alias("a"), F.col("vec_id").alias("b")).distinct()
        near = linked(first, own, codes, d, many, seed, threshold, scratch, "edges1")
        label = components(near, scratch)
        named = members.join(label.hint("merge").withColumnRenamed("node", "vec_id"), "vec_id", "left").select("k", "vec_id", "head", F.coalesce("root", "vec_id").alias("root"))
        torn = named.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("k")
        open_ = named.join(torn.hint("merge"), "k").where("vec_id <> head").join(codes.select("vec_id", "words").hint("merge"), "vec_id")
        open_ = scratch.keep(open_.select("k", "vec_id", "root", *[F.col("words")[i].alias(f"w{i}") for i in range(WORDS)]), "open")
        x, y = open_.alias("x"), open_.alias("y")
        signs = min(WORDS * 64, many * d)
        apart = sum((F.bit_count(F.col(f"x.w{i}").bitwiseXOR(F.col(f"y.w{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("x.w0").bitwiseXOR(F.col("y.w0"))))
        cross = x.join(y, F.expr("x.k = y.k and x.vec_id < y.vec_id and x.root <> y.root") & (apart <= farthest(signs, threshold)))
        cross = cross.select(F.col("x.vec_id").alias("a"), F.col("y.vec_id").alias("b")).distinct()
        more = linked(cross, own, codes, d, many, seed, threshold, scratch, "edges2")
        edges = edges.unionByName(near).unionByName(more)
        used += [codes, members, open_, near, more]
    out = components(scratch.keep(edges.distinct(), "edges"), scratch).select(F.col("node").alias("vec_id"), F.col("root").alias("keep_id"))
    scratch.drop(rows, *used)
    return out
