"""Fusion of ranked lists. Lists are (leg, query_id, doc_id, score) in one frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.session import keep


def legs(**lists: DataFrame) -> DataFrame:
    """The lists in one frame, each under its name."""
    out = None
    for name, df in lists.items():
        part = df.select(F.lit(name).alias("leg"), "query_id", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def rrf(lists: DataFrame, k: float = 60.0, depth: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the lists in which a document has a finite score above 0."""
    live = lists.where("score > 0 and score < double('inf')")
    rank = F.row_number().over(Window.partitionBy("leg", "query_id").orderBy(F.desc(F.round("score", 8)), "doc_id"))
    ranked = live.withColumn("rank", rank)
    if depth is not None:
        ranked = ranked.where(F.col("rank") <= depth)
    return ranked.groupBy("query_id", "doc_id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


#: Scores whose ranks are counted at once; more are ranked by windows over the lists.
MOST_OPEN = 2_000_000


def long(wide: DataFrame, names: list[str]) -> DataFrame:
    """(leg, query_id, doc_id, score) of a scan's legs."""
    return wide.unpivot(["query_id", "doc_id"], names, "leg", "score").where("score is not null").select("leg", "query_id", "doc_id", "score")


def rrf_best(found, most: int, k: float = 60.0, depth: int | None = None) -> DataFrame | None:
    """(query_id, doc_id, score): ``rrf`` of a scan's legs for all documents that can be among the ``most`` best of a query; None where too many stay open.

    Of each leg the best ``depth`` are ranked. They give each document met a
    least and a greatest sum, and a greatest one for all others; for those that
    can still be among the best, the missing ranks are counted. Where documents
    never met could be, depth grows.
    """
    names, depth = list(found.legs), depth or 4 * most + 20
    while True:
        lists = long(found.best(depth), names).where("score > 0 and score < double('inf')")
        own = Window.partitionBy("leg", "query_id").orderBy(F.desc(F.round("score", 8)), "doc_id")
        ranked = keep(lists.withColumn("rank", F.row_number().over(own)), "ranked")
        at = F.when(F.col("rank") <= depth, 1 / (F.lit(float(k)) + F.col("rank")))
        per = ranked.groupBy("query_id", "doc_id").agg(F.coalesce(F.sum(at), F.lit(0.0)).alias("low"), F.sum(F.when(F.col("rank") > depth, 1).otherwise(0)).alias("open"))
        least = per.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))).where(F.col("r") <= most).groupBy("query_id").agg(F.count("*").alias("n"), F.min("low").alias("least"))
        least = least.select("query_id", F.when(F.col("n") == most, F.col("least")).otherwise(0.0).alias("least"))
        full = ranked.where(F.col("rank") == depth).groupBy("query_id").agg((F.count("*") / F.lit(float(k) + depth + 1)).alias("unmet"))
        if not full.join(least, "query_id").where("unmet >= least - 1e-8").limit(1).count():
            break
        depth *= 4
        if depth > MOST_OPEN // max(1, len(found.queries)):
            return None
    near = per.join(least, "query_id").where(F.col("low") + F.col("open") / F.lit(float(k) + depth + 1) >= F.col("least") - 1e-8)
    near = keep(near.select("query_id", "doc_id", "low", "open"), "near")
    missing = ranked.where(F.col("rank") > depth).join(near.where("open > 0").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    if missing.limit(MOST_OPEN + 1).count() > MOST_OPEN:
        return None
    rest = missing.select("leg", "query_id", "doc_id", "score")
    if rest.limit(1).count():
        counted = rest.join(found.above(rest), ["leg", "query_id", "doc_id"], "left")
        more = counted.groupBy("query_id", "doc_id").agg(F.sum(1 / (F.lit(float(k)) + 1 + F.coalesce("n", F.lit(0)))).alias("more"))
        near = near.join(more, ["query_id", "doc_id"], "left")
    else:
        near = near.withColumn("more", F.lit(0.0))
    return near.select("query_id", "doc_id", (F.col("low") + F.coalesce("more", F.lit(0.0))).alias("score"))


def _per_leg(lists: DataFrame, scaled, weights: dict[str, float]) -> DataFrame:
    own = Window.partitionBy("leg", "query_id")
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("leg")], F.lit(0.0))
    return lists.withColumn("score", scaled(own) * w).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def convex_z(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The weighted sum of z-scores (population deviation + 1e-12), each taken within its leg and query over the rows given."""
    s = F.col("score")
    return _per_leg(lists, lambda w: (s - F.avg(s).over(w)) / (F.stddev_pop(s).over(w) + 1e-12), weights)


def min_max(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The weighted sum of scores scaled to 0 to 1 within their leg and query."""
    s = F.col("score")
    return _per_leg(lists, lambda w: F.when(F.max(s).over(w) > F.min(s).over(w), (s - F.min(s).over(w)) / (F.max(s).over(w) - F.min(s).over(w))).otherwise(0.0), weights)


def comb_sum(lists: DataFrame) -> DataFrame:
    """The sum of min-max scaled scores."""
    s = F.col("score")
    own = Window.partitionBy("leg", "query_id")
    scaled = F.when(F.max(s).over(own) > F.min(s).over(own), (s - F.min(s).over(own)) / (F.max(s).over(own) - F.min(s).over(own))).otherwise(0.0)
    return lists.withColumn("score", scaled).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def pool_union(lists: DataFrame, per_leg: int) -> DataFrame:
    """(query_id, doc_id): every document among the best ``per_leg`` of any leg."""
    rank = F.row_number().over(Window.partitionBy("leg", "query_id").orderBy(F.desc(F.round("score", 8)), "doc_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= per_leg).select("query_id", "doc_id").distinct()


def over_pool(lists: DataFrame, pool: DataFrame, names: list[str]) -> DataFrame:
    """The scores of each of the legs named on the pool, 0 where a leg has none: what z-scores over a pool need."""
    every = pool.withColumn("leg", F.explode(F.array(*map(F.lit, names))))
    return every.join(lists, ["leg", "query_id", "doc_id"], "left").fillna(0.0, ["score"])


def finite(ranking: DataFrame) -> DataFrame:
    """A ranking without null, NaN and infinite scores."""
    return ranking.where("score is not null and not isnan(score) and abs(score) < double('inf')")
