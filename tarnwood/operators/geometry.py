"""Reranking by the geometry of a query's pool of fragments.

Pool, gather and blend are joins and windows over all queries; whitening,
similarities, the graph and the diffusion run on each query's own pool, whose
size the configuration bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.functions import vectors as V
from tarnwood.session import keep

from . import evaluate, fusion, rankers, topology

SCORERS = ("max", "mean", "top_k_mean", "soft_max", "geo_mean")


@dataclass(frozen=True)
class GeometryConfig:
    pool: int = 100
    alpha: float = 0.8
    per_doc: int = 4
    attention: float = 8.0
    knn: int = 8
    steps: int = 2
    use_scale: bool = True
    criterion: str = "approx"
    adaptive: bool = False
    least_confidence: float = 0.55
    outer: str | None = None
    whiten: bool = True
    top_k: int = 3
    beta: float = 4.0
    dense_pool: int = 0
    csls_k: int = 0
    csls_beta: float = 1.0
    prefix: int = 0

    def __post_init__(self):
        wrong = [
            (self.pool < 1, "pool"),
            (not 0 <= self.alpha <= 1, "alpha"),
            (self.per_doc < 1, "per_doc"),
            (not np.isfinite(self.attention) or self.attention <= 0, "attention"),
            (self.knn < 1 and not self.use_scale, "knn"),
            (self.steps < 0, "steps"),
            (self.criterion not in ("approx", "largest_gap", "max_persistence", "elbow"), "criterion"),
            (not 0 <= self.least_confidence <= 1, "least_confidence"),
            (self.outer is not None and self.outer not in SCORERS, "outer"),
            (self.top_k < 1, "top_k"),
            (not np.isfinite(self.beta), "beta"),
            (min(self.dense_pool, self.csls_k, self.prefix) < 0, "counts"),
            (not np.isfinite(self.csls_beta) or self.csls_beta < 0, "csls_beta"),
            (self.outer is not None and self.csls_k > 0, "an outer scorer takes no csls"),
            (self.adaptive and not self.use_scale, "adaptive needs a scale"),
        ]
        for bad, what in wrong:
            if bad:
                raise ValueError(f"geometry configuration: {what}")


def confidence(sims: np.ndarray) -> float:
    """How sure a query's similarities are: height of the best, its lead, and how little they are spread."""
    clip = lambda x: float(min(1.0, max(0.0, x)))
    two = np.sort(np.r_[sims, 0.0, 0.0])[::-1]
    p = np.maximum(sims, 0)
    p = p[p > 0] / p.sum() if p.sum() > 0 else p[:0]
    spread = -(p * np.log(p)).sum() / np.log(2 + len(sims))
    return clip(0.4 * clip((two[0] - 0.10) / 0.25) + 0.35 * clip((two[0] - two[1] - 0.02) / 0.12) + 0.25 * (1 - clip(spread)))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(-1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def whitened(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, sd = x.mean(0), np.sqrt(x.var(0) + 1e-6)
    return _unit((q - mean) / sd), _unit((x - mean) / sd)


def csls(qsim: np.ndarray, s: np.ndarray, k: int, beta: float) -> np.ndarray:
    """Similarities to the query less each fragment's mean similarity to its k nearest others."""
    n = len(s)
    if k < 1 or n < 2:
        return qsim
    own = s.copy()
    np.fill_diagonal(own, -np.inf)
    k = min(k, n - 1)
    return qsim - beta * -np.sort(-own, axis=1)[:, :k].mean(1)


def adjacency(s: np.ndarray, scale: float | None, knn: int, sharpness: float) -> np.ndarray:
    """Row-stochastic weights: pairs at or above the scale, or each fragment's nearest; rows without an edge are 0."""
    n = len(s)
    own = s.copy()
    np.fill_diagonal(own, -np.inf)
    if scale is not None:
        keep = own >= scale
    else:
        keep = np.zeros((n, n), bool)
        near = np.lexsort((np.broadcast_to(np.arange(n), (n, n)), -own), axis=1)[:, : min(knn, n - 1)]
        np.put_along_axis(keep, near, True, 1)
    logits = np.where(keep, sharpness * own, -np.inf)
    top = logits.max(1, keepdims=True) if n else logits
    w = np.where(keep, np.exp(logits - np.where(np.isfinite(top), top, 0)), 0.0)
    total = w.sum(1, keepdims=True)
    return np.divide(w, total, out=np.zeros_like(w), where=total > 0)


def diffuse(mass: np.ndarray, w: np.ndarray, steps: int) -> np.ndarray:
    """Half of each fragment's mass stays, half goes along its edges; one without edges loses it."""
    for _ in range(steps):
        mass = 0.5 * mass + 0.5 * (mass @ w)
    return mass


def fragment_mass(q: np.ndarray, x: np.ndarray, c: GeometryConfig) -> tuple[np.ndarray, np.ndarray]:
    """(similarity to the query, diffused attention) of a pool's fragments."""
    q, x = whitened(q, x) if c.whiten else (_unit(q), _unit(x))
    qsim = x @ q
    if c.outer:
        return qsim, np.zeros(len(x))
    g = _unit(x[:, : c.prefix]) if 0 < c.prefix < x.shape[1] else x
    s = g @ g.T
    scale = None
    if c.use_scale and (not c.adaptive or confidence(qsim) >= c.least_confidence):
        found = topology.scale_of(s, c.criterion)
        scale = found if found > 0 else None
    logits = c.attention * csls(qsim, s, c.csls_k, c.csls_beta)
    mass = np.exp(logits - logits.max())
    return qsim, diffuse(mass / mass.sum(), adjacency(s, scale, c.knn, c.attention), c.steps)


def pool_fragments(pool: DataFrame, fragments: DataFrame, per_doc: int) -> DataFrame:
    return pool.join(fragments.where(F.col("frag_idx") < per_doc).select("doc_id", "frag_idx", "vec"), "doc_id")


def aggregate(sims: DataFrame, c: GeometryConfig, scorer: str = "max") -> DataFrame:
    """(query_id, doc_id, geometry) of ``sims(query_id, doc_id, sim)`` by one of the outer scorers."""
    own = Window.partitionBy("query_id", "doc_id")
    if scorer == "max":
        return sims.groupBy("query_id", "doc_id").agg(F.max("sim").alias("geometry"))
    if scorer == "mean":
        return sims.groupBy("query_id", "doc_id").agg(F.avg("sim").alias("geometry"))
    if scorer == "top_k_mean":
        return sims.withColumn("rn", F.row_number().over(own.orderBy(F.desc("sim")))).where(F.col("rn") <= c.top_k).groupBy("query_id", "doc_id").agg(F.avg("sim").alias("geometry"))
    if scorer == "soft_max":
        w = F.exp(F.lit(c.beta) * (F.col("sim") - F.max("sim").over(own)))
        return sims.withColumn("w", w).groupBy("query_id", "doc_id").agg((F.sum(F.col("w") * F.col("sim")) / F.sum("w")).alias("geometry"))
    if scorer == "geo_mean":
        shift = F.greatest(F.lit(0.0), F.lit(1e-3) - F.min("sim").over(own))
        return sims.withColumn("shift", shift).groupBy("query_id", "doc_id").agg((F.exp(F.avg(F.log(F.col("sim") + F.col("shift")))) - F.first("shift")).alias("geometry"))
    raise ValueError(scorer)


def rerank(scores: DataFrame, queries: DataFrame, docs: DataFrame, query_vectors: DataFrame, fragments: DataFrame | Callable[[DataFrame], DataFrame], c: GeometryConfig = GeometryConfig(), doc_vectors: DataFrame | None = None, pool: DataFrame | None = None, score_pairs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, doc_id, score) for each query's pool: alpha * z(first pass) + (1 - alpha) * z(geometry). Documents outside the pool have no row.

    ``query_vectors`` is (query_id, vec). With ``dense_pool`` and
    ``doc_vectors(doc_id, vec)`` the documents nearest to the query join the pool.
    A ``pool(query_id, doc_id)`` that is given takes the place of the best ``c.pool``.
    ``fragments`` may be a function of the pool's ``doc_id``s, whose fragments alone are then made;
    with ``score_pairs``, which scores given pairs, ``scores`` need only hold the best ``c.pool``.
    """
    of = score_pairs or (lambda pairs: scores)
    if pool is None:
        pool = rankers.top_dense(scores, queries, docs, c.pool).select("query_id", "doc_id", "score")
    else:
        pool = pool.join(of(pool), ["query_id", "doc_id"], "left").fillna(0.0, ["score"]).select("query_id", "doc_id", "score")
    if c.dense_pool and doc_vectors is not None:
        near = keep(evaluate.exact_dense(query_vectors, doc_vectors, c.dense_pool).select("query_id", "doc_id"), "near")
        more = near.join(pool, ["query_id", "doc_id"], "left_anti").join(of(near), ["query_id", "doc_id"], "left").fillna(0.0, ["score"])
        pool = pool.unionByName(more.select("query_id", "doc_id", "score"))
    pool = keep(pool, "pool")
    if callable(fragments):
        fragments = fragments(pool.select("doc_id").distinct())
    rows = pool_fragments(pool.select("query_id", "doc_id"), fragments, c.per_doc).join(query_vectors.withColumnRenamed("vec", "qv"), "query_id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "frag_idx"])
        qsim, mass = fragment_mass(np.asarray(group["qv"].iloc[0], float), np.stack(group["vec"].to_numpy()).astype(float), c)
        return pd.DataFrame({"query_id": group["query_id"], "doc_id": group["doc_id"], "sim": qsim, "mass": mass})

    kinds = {k: scores.schema[k].dataType.simpleString() for k in ("query_id", "doc_id")}
    done = rows.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, sim double, mass double")
    geom = aggregate(done, c, c.outer) if c.outer else done.groupBy("query_id", "doc_id").agg(F.sum("mass").alias("geometry"))
    both = pool.join(geom, ["query_id", "doc_id"], "left").fillna(0.0, ["geometry"])
    legs = fusion.legs(first=both.select("query_id", "doc_id", "score"), geometry=both.select("query_id", "doc_id", F.col("geometry").alias("score")))
    return fusion.convex_z(legs, {"first": c.alpha, "geometry": 1 - c.alpha})


def doc_topology(fragments: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, mean_sim, gap): the mean cosine of a document's fragments and the widest gap among the sorted cosines; 0 with fewer than two."""
    f = fragments.where(F.col("frag_idx") < most).select("doc_id", "frag_idx", V.l2_normalize(F.col("vec")).alias("vec"))
    pairs = f.alias("x").join(f.alias("y"), F.expr("x.doc_id = y.doc_id and x.frag_idx < y.frag_idx")).select(F.col("x.doc_id").alias("doc_id"), V.dot(F.col("x.vec"), F.col("y.vec")).alias("sim"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("sim"))
    gaps = pairs.withColumn("gap", F.col("sim") - F.lead("sim").over(order))
    per = gaps.groupBy("doc_id").agg(F.avg("sim").alias("mean_sim"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"))
    return fragments.select("doc_id").distinct().join(per, "doc_id", "left").fillna(0.0)
