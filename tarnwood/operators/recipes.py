"""Named retrieval recipes over one pool, and a workspace for fragment reranking.

The six legs, the pool and the fragments are written once; each recipe is a
fusion over them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.functions import text as T
from tarnwood.session import keep

from . import embed, evaluate, feedback, fragments, fusion, geometry, pmi, rankers
from . import lexindex as lx

PROMOTED = {"wsdm_sab": 0.6, "wsdm": 0.4}


@dataclass
class Pooled:
    """legs(leg, query_id, doc_id, score) of six rankings, the pool(query_id, doc_id) of their best documents, and what geometry needs."""

    legs: DataFrame
    pool: DataFrame
    fragments: DataFrame
    query_vectors: DataFrame

    def over(self, names: list[str], more: DataFrame | None = None) -> DataFrame:
        lists = self.legs if more is None else self.legs.unionByName(more)
        return fusion.over_pool(lists.where(F.col("leg").isin(names)), self.pool, names)


def word_vectors(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(key, vec): the unit sum of the word vectors of ``rows(key, text)``."""
    worded = rows.select(F.col(key).alias("doc_id"), T.terms("text").alias("terms"))
    return fragments.sif_vectors(worded, table, None).withColumnRenamed("doc_id", key)


def six_legs(docs: DataFrame, queries: DataFrame, config: embed.EncoderConfig = embed.COMPACT, per_leg: int = 100, table: DataFrame | None = None) -> Pooled:
    """The legs Atire, its weighted dependence, subword backoff and its own, geometry, and five variants by reciprocal ranks, as far as they matter to the pool.

    Geometry is over word vectors where a ``table(token, vec)`` is given, else
    over the encoder's.
    """
    names, five = ("atire", "wsdm", "sab", "wsdm_sab"), ("atire", "plus", "bm25l", "dlh13", "dcm")
    found = rankers.scanned(docs, queries, names[:3])
    fused = None
    if found is not None:
        scaled = lambda leg, w: [(source, variant, {k: v * w for k, v in weights.items()}) for source, variant, weights in found.legs[leg]]
        found.legs["wsdm_sab"] = scaled("sab", rankers.DEFAULT.unigram) + [part for part in found.legs["wsdm"] if part[0] != "word"]
        found.by = names
        fused = fusion.rrf_best(rankers.scanned(docs, queries, five), per_leg)
    if fused is None:
        atire, wsdm, sab = (keep(rankers.score(docs, queries, v), v) for v in names[:3])
        dependence = rankers.summed(wsdm, rankers.weighted(atire, -rankers.DEFAULT.unigram))
        wsdm_sab = keep(rankers.summed(rankers.weighted(sab, rankers.DEFAULT.unigram), dependence), "wsdm_sab")
        lists = fusion.legs(atire=atire, wsdm=wsdm, sab=sab, wsdm_sab=wsdm_sab)
        variants = keep(fusion.rrf(rankers.score_many(docs, queries, five)), "rrf")
    else:
        lists = keep(fusion.long(found.best(per_leg), list(names)), "lists")
        variants = keep(fused, "rrf")
        atire = lists.where("leg = 'atire'").drop("leg")
    # geometry reranks the best of Atire, so it adds no document to these
    first = rankers.top_dense(atire, queries, docs, per_leg).select("query_id", "doc_id")
    pool = fusion.pool_union(lists.unionByName(fusion.legs(rrf=variants)), per_leg).unionByName(first).distinct()
    pool = keep(pool, "pool")
    frags = keep(fragments.build(among(docs, pool), lx.statistics(lx.words(docs)), config, table=table), "fragments")
    asked = keep(word_vectors(queries, table, "query_id") if table is not None else embed.encode(queries, config, key="query_id"), "asked")
    geom = keep(geometry.rerank(atire, queries, docs, asked, frags, geometry.GeometryConfig(alpha=0.0, pool=per_leg)), "geometry")
    if fused is not None:
        lists = fusion.long(found.pairs(pool), list(names))
    legs = keep(lists.unionByName(fusion.legs(geometry=geom, rrf=variants)), "legs")
    return Pooled(legs, keep(fusion.pool_union(legs, per_leg), "pool"), frags, asked)


def among(docs: DataFrame, pool: DataFrame) -> DataFrame:
    """The documents of a pool."""
    return docs.join(pool.select("doc_id").distinct(), "doc_id", "left_semi")


def promoted(p: Pooled) -> DataFrame:
    """0.6 z(backoff dependence) + 0.4 z(Atire dependence) over the pool."""
    return fusion.convex_z(p.over(list(PROMOTED)), PROMOTED)


def soft_feedback(scores: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, w): the best k documents with softmax weights."""
    best = rankers.top(scores, k)
    return best.select("query_id", "doc_id", F.exp(F.col("score") - F.max("score").over(Window.partitionBy("query_id"))).alias("w"))


def recipes(docs: DataFrame, queries: DataFrame, config: embed.EncoderConfig = embed.COMPACT, per_leg: int = 100, table: DataFrame | None = None, qrels: DataFrame | None = None, dense: DataFrame | None = None) -> DataFrame:
    """(recipe, query_id, doc_id, score) of every named recipe over the six legs' pool.

    Four baselines; pure geometry and its versions against hubs; the promoted
    fusion, with min-max instead of z-scores, with feedback from itself, with
    geometry, and with two features of each document's own fragments; geometry
    over tempered word vectors where a table is given; ``dense(query_id, doc_id,
    score)`` as a reference; and with ``qrels`` the order no fusion can beat.
    """
    p = six_legs(docs, queries, config, per_leg, table)
    atire = p.legs.where("leg = 'atire'").drop("leg")
    out = {"bm25_atire": atire, **{f"{n}": p.legs.where(F.col("leg") == n).drop("leg") for n in ("sab", "wsdm", "wsdm_sab")}}

    def geom(c: geometry.GeometryConfig, frags: DataFrame = p.fragments, asked: DataFrame = p.query_vectors) -> DataFrame:
        return keep(geometry.rerank(atire, queries, docs, asked, frags, c, pool=p.pool), "geometry")

    pure = geometry.GeometryConfig(alpha=0.0)
    out["geometry"] = geom(pure)
    for k, b in ((8, 1.0), (8, 0.5), (16, 1.0)):
        out[f"geometry_csls{k}_b{b}"] = geom(replace(pure, csls_k=k, csls_beta=b))
    best = out["promoted"] = keep(promoted(p), "promoted")
    out["promoted_min_max"] = fusion.min_max(p.over(list(PROMOTED)), PROMOTED)
    with_leg = lambda name, df, w, base=PROMOTED: fusion.convex_z(p.over([name, *base], df.select(F.lit(name).alias("leg"), "query_id", "doc_id", "score")), {name: w} | base)
    again = keep(feedback.rm3(docs, queries, feedback=soft_feedback(best), pool=p.pool), "again")
    out["promoted_feedback"] = with_leg("again", again, 0.30, {"wsdm_sab": 0.42, "wsdm": 0.28})
    for w in (0.1, 0.2, 0.3):
        out[f"promoted_csls_{w}"] = fusion.convex_z(fusion.over_pool(fusion.legs(promoted=best, csls=out["geometry_csls8_b1.0"]), p.pool, ["promoted", "csls"]), {"promoted": 1 - w, "csls": w})
    shape = keep(geometry.doc_topology(p.fragments), "shape")
    for what, column in (("gap", "gap"), ("coherence", "mean_sim")):
        feature = p.pool.join(shape, "doc_id", "left").select("query_id", "doc_id", F.coalesce(column, F.lit(0.0)).alias("score"))
        for w in (0.1, 0.2):
            out[f"promoted_{what}_{w}"] = fusion.convex_z(fusion.over_pool(fusion.legs(promoted=best, shape=feature), p.pool, ["promoted", "shape"]), {"promoted": 1 - w, "shape": w})
    if table is not None:
        stats, pooled = keep(lx.statistics(lx.words(docs)), "stats"), keep(among(docs, p.pool), "pooled")
        for alpha in (0.0, 0.25, 0.5, 0.75, 1.0):
            own = keep(pmi.temper(table, alpha), "tempered")
            frags = keep(fragments.build(pooled, stats, config, table=own), "fragments")
            out[f"geometry_tempered_{alpha}"] = geom(replace(pure, whiten=False), frags, word_vectors(queries, own, "query_id"))
    if dense is not None:
        out["reference_dense"] = dense
    if qrels is not None:
        out["pool_oracle"] = p.pool.join(qrels, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce(F.col("relevance"), F.lit(0)).cast("double").alias("score"))
    rows = None
    for name, df in out.items():
        part = df.select(F.lit(name).alias("recipe"), "query_id", "doc_id", "score")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def recipe_rows(rows: DataFrame, qrels: DataFrame) -> DataFrame:
    """(recipe, ndcg10, p10, r10, r100, mrr10, queries): the mean metrics of each recipe, by one evaluation over all."""
    kept = keep(rows.withColumn("query_id", F.struct("recipe", "query_id")).drop("recipe"), "recipes")
    names = kept.select("query_id.recipe").distinct()
    judged = qrels.crossJoin(F.broadcast(names)).select(F.struct("recipe", "query_id").alias("query_id"), "doc_id", "relevance")
    per = evaluate.metrics(kept, judged)
    means = [F.avg(c).alias(c) for c in per.columns if c != "query_id"]
    return per.groupBy(F.col("query_id.recipe").alias("recipe")).agg(*means, F.count("*").alias("queries"))


@dataclass(frozen=True)
class RerankerConfig:
    """What a workspace is made for (all but ``geometry``), and how it reranks."""

    builder: str = "rich_covered"
    storage: str = "float"  # float, bf16
    encoder: str = "hashed"  # hashed, pmi
    config: embed.EncoderConfig = embed.COMPACT
    top: int = 4
    terms: int = 8
    sentence_cap: float = 0.6
    anchor_cap: float = 0.9
    rank: int = 64
    geometry: geometry.GeometryConfig = field(default_factory=geometry.GeometryConfig)

    def __post_init__(self):
        wrong = [
            (self.builder not in ("basic", "rich", "rich_covered"), "builder"),
            (self.storage not in ("float", "bf16"), "storage"),
            (self.encoder not in ("hashed", "pmi"), "encoder"),
            (min(self.top, self.terms, self.rank) < 1, "counts"),
            (not 0 <= self.sentence_cap <= 1 or not 0 <= self.anchor_cap <= 1, "caps"),
        ]
        for bad, what in wrong:
            if bad:
                raise ValueError(f"reranker configuration: {what}")

    def identity(self) -> RerankerConfig:
        return replace(self, geometry=geometry.GeometryConfig())


class Workspace:
    """First-pass scores, query vectors and, where all are asked for, fragments of a fixture, made once; each run is one reranking over them."""

    def __init__(self, docs: DataFrame, queries: DataFrame, config: RerankerConfig = RerankerConfig()):
        if docs.limit(1).count() == 0 or queries.limit(1).count() == 0:
            raise ValueError("a fixture needs queries and documents")
        self.docs, self.queries, self.config = docs, queries, config
        rows = lx.words(docs)
        self.stats = lx.statistics(rows)
        self.table = keep(pmi.vectors(rows, rank=config.rank), "table") if config.encoder == "pmi" else None
        self.asked = keep(word_vectors(queries, self.table, "query_id") if self.table is not None else embed.encode(queries, config.config, key="query_id"), "asked")
        self.found = rankers.scanned(docs, queries, ("atire",))
        self.lists: dict[int, DataFrame] = {}
        self._stored: DataFrame | None = None

    def made(self, docs: DataFrame) -> DataFrame:
        """The fragments of documents, as they are stored."""
        c = self.config
        out = fragments.build(docs, self.stats, c.config, c.builder, c.top, c.terms, table=self.table, sentence_cap=c.sentence_cap, anchor_cap=c.anchor_cap)
        return fragments.packed(out) if c.storage == "bf16" else out

    @property
    def stored(self) -> DataFrame:
        """The fragments of all documents; a run before they are asked for makes those of its pool."""
        if self._stored is None:
            self._stored = keep(self.made(self.docs), "fragments")
        return self._stored

    def baseline(self, k: int) -> DataFrame:
        """First-pass scores, as far as they can be among the k best."""
        if k not in self.lists:
            self.lists[k] = keep(rankers.score(self.docs, self.queries) if self.found is None else rankers.leg(self.found.best(k), "atire"), "baseline")
        return self.lists[k]

    def compatible(self, config: RerankerConfig) -> bool:
        return self.config.identity() == config.identity()

    def run(self, config: RerankerConfig) -> DataFrame:
        """(query_id, doc_id, score) of the reranked pools."""
        if not self.compatible(config):
            raise ValueError("the configuration doesn't fit what the workspace holds")
        of = (lambda ids: self.stored) if self._stored is not None else (lambda ids: self.made(among(self.docs, ids)))
        frags = (lambda ids: fragments.unpacked(of(ids))) if config.storage == "bf16" else of
        return geometry.rerank(self.baseline(config.geometry.pool), self.queries, self.docs, self.asked, frags, config.geometry)

    def profile(self) -> DataFrame:
        """One row: documents with fragments, fragments, and their vectors' bytes."""
        size = 2 if self.config.storage == "bf16" else 8
        return self.stored.agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("fragments"), (F.sum(F.size("vec")) * size).alias("vector_bytes"))
