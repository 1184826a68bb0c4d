"""Query performance features, and the recipes chosen from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexindex as lx
from . import rankers


@dataclass(frozen=True)
class RouterConfig:
    oov: float = 0.0
    high_idf: float = 3.0
    min_terms: int = 0
    min_idf_floor: float = 0.0
    max_jaccard: float = 1.0
    min_decay: float = 0.0
    min_scq: float = 0.0
    max_clarity: float = float("inf")
    cascade_min_terms: int = 4
    cascade_max_idf: float = 5.0
    geometry_min_terms: int = 6
    max_min_terms: int = 12
    max_max_idf: float = 3.0


def features(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a query: n_terms, oov_rate, avg_idf, max_idf, min_idf, idf_stddev, avg_term_chars, scq, clarity. Repeated terms count repeatedly, in clarity once with their share."""
    asked = lx.query_words(queries)
    terms = lx.query_terms(asked)
    index = lx.build(lx.words(docs), terms)
    known = terms.join(index.stats, "term", "left").crossJoin(F.broadcast(index.corpus))
    size = Window.partitionBy("query_id")
    q, idf = F.col("qtf"), F.col("idf")
    known = known.withColumn("n_q", F.sum("qtf").over(size))
    share = q / F.col("n_q")
    present = F.sum(F.when(F.col("df") > 0, q))
    mean = F.sum(q * idf) / present
    variance = F.sum(q * idf * idf) / present - mean * mean
    out = known.groupBy("query_id").agg(
        F.sum("qtf").alias("n_terms"),
        (F.coalesce(F.sum(F.when(F.col("df").isNull(), q)), F.lit(0)) / F.sum("qtf")).alias("oov_rate"),
        F.coalesce(mean, F.lit(0.0)).alias("avg_idf"),
        F.coalesce(F.max("idf"), F.lit(0.0)).alias("max_idf"),
        F.coalesce(F.min("idf"), F.lit(0.0)).alias("min_idf"),
        F.when(present > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0).alias("idf_stddev"),
        (F.sum(q * F.length("term")) / F.sum("qtf")).alias("avg_term_chars"),
        F.coalesce(F.sum(q * (1 + F.log("ttf")) * idf), F.lit(0.0)).alias("scq"),
        F.coalesce(F.sum(share * F.log(share / (F.col("ttf") / F.col("total")))), F.lit(0.0)).alias("clarity"),
    )
    names = [c for c in out.columns if c != "query_id"]
    return queries.select("query_id").join(out, "query_id", "left").fillna(0, names)


def pool_features(scores: DataFrame, queries: DataFrame, docs: DataFrame, n_terms: DataFrame, k: int = 50, other: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    """One row a query from its best k scores, unmatched documents counting as 0: decay, normalised_var, nqc, wig, entropy, and the overlap with the best k of ``other``.

    Statistics over the corpus come from sums, so no score is made for unmatched documents. Where
    ``sums(query_id, s)`` of all scores are given, ``scores`` and ``other`` need only hold the best k.
    """
    n = docs.agg(F.count("*").alias("n"))
    best = rankers.top_dense(scores, queries, docs, k)
    mean_all = queries.select("query_id").join(scores.groupBy("query_id").agg(F.sum("score").alias("s")) if sums is None else sums.select("query_id", "s"), "query_id", "left").crossJoin(F.broadcast(n)).select("query_id", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("corpus_mean"))
    own = Window.partitionBy("query_id")
    e = F.exp(F.col("score") - F.max("score").over(own))
    p = best.withColumn("p", e / F.sum(e).over(own))
    per = p.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.max_by("score", F.when(F.col("rank") <= 10, F.col("rank"))).alias("s10"),
        F.avg("score").alias("mean"),
        F.var_pop("score").alias("var"),
        (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")))).alias("entropy"),
    )
    out = per.join(mean_all, "query_id").join(n_terms.select("query_id", "n_terms"), "query_id").select(
        "query_id",
        F.when(F.col("s1") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("s1") - F.col("s10")) / F.col("s1")))).otherwise(0.0).alias("decay"),
        F.when(F.col("mean") > 0, F.col("var") / F.col("mean")).otherwise(0.0).alias("normalised_var"),
        F.when(F.col("corpus_mean") > 0, F.sqrt("var") / F.col("corpus_mean")).otherwise(0.0).alias("nqc"),
        F.when(F.col("n_terms") > 0, (F.col("mean") - F.col("corpus_mean")) / F.sqrt("n_terms")).otherwise(0.0).alias("wig"),
        "entropy",
    )
    if other is None:
        return out.withColumn("jaccard", F.lit(1.0))
    second = rankers.top_dense(other, queries, docs, k).select("query_id", "doc_id", F.lit(1).alias("b"))
    both = best.select("query_id", "doc_id", F.lit(1).alias("a")).join(second, ["query_id", "doc_id"], "full")
    jaccard = both.groupBy("query_id").agg((F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)) / F.count("*")).alias("jaccard"))
    return out.join(jaccard, "query_id")


def _column(df: DataFrame, name: str, default: float) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def _gates(df: DataFrame, c: RouterConfig) -> Column:
    out = (F.col("avg_idf") > c.high_idf) & (F.col("n_terms") >= c.min_terms) & (F.col("min_idf") >= c.min_idf_floor)
    out &= (_column(df, "jaccard", 1.0) <= c.max_jaccard) & (_column(df, "decay", 0.0) >= c.min_decay)
    return out & (F.col("scq") >= c.min_scq) & (F.col("clarity") <= F.lit(c.max_clarity))


def choose(df: DataFrame, c: RouterConfig = RouterConfig()) -> DataFrame:
    """The feature rows with ``recipe``: sab for queries with unknown words, atire for rare ones, cascade for long common ones, else sab."""
    recipe = F.when(F.col("n_terms") == 0, "sab").when(F.col("oov_rate") > c.oov, "sab").when(_gates(df, c), "atire")
    return df.withColumn("recipe", recipe.when((F.col("n_terms") >= c.cascade_min_terms) & (F.col("avg_idf") <= c.cascade_max_idf), "cascade").otherwise("sab"))


def choose_quality(df: DataFrame, c: RouterConfig = RouterConfig()) -> DataFrame:
    """The feature rows with ``quality_recipe``: bm25, geometry, or geometry_max for the longest common queries."""
    recipe = F.when((F.col("n_terms") == 0) | (F.col("oov_rate") > c.oov) | _gates(df, c), "bm25")
    recipe = recipe.when((F.col("n_terms") < c.geometry_min_terms) | (F.col("avg_idf") > c.cascade_max_idf), "bm25")
    return df.withColumn("quality_recipe", recipe.when((F.col("n_terms") >= c.max_min_terms) & (F.col("avg_idf") <= c.max_max_idf), "geometry_max").otherwise("geometry"))


def entropy(best: DataFrame) -> DataFrame:
    """(query_id, entropy, margin) of ranked rows: the softmax entropy over log k, k being the rows of a query, and the share by which the first leads."""
    own = Window.partitionBy("query_id")
    e = F.exp(F.col("score") - F.max("score").over(own))
    p = best.withColumn("p", e / F.sum(e).over(own))
    k = F.count("*")
    s1, s2 = (F.max(F.when(F.col("rank") == r, F.col("score"))) for r in (1, 2))
    return p.groupBy("query_id").agg(
        F.when(k >= 2, -F.sum(F.when(F.col("p") > 1e-12, F.col("p") * F.log("p"))) / F.log(k)).otherwise(0.0).alias("entropy"),
        F.when(k >= 2, (s1 - s2) / F.greatest(F.lit(1e-6), F.abs(s1))).otherwise(0.0).alias("margin"),
        k.alias("k"),
    )


def assess_quality(best: DataFrame) -> DataFrame:
    """(query_id, quality): 3 * (1 - entropy of the best ten) + the first one's lead; 0 with fewer than two."""
    return entropy(best.where("rank <= 10")).select("query_id", F.when(F.col("k") >= 2, 3 * (1 - F.col("entropy")) + F.col("margin")).otherwise(0.0).alias("quality"))


def route_by_entropy(profile: DataFrame, names: tuple[str, ...] = ("first", "second", "third"), low: float = 0.05, high: float = 0.50) -> DataFrame:
    """(query_id, strategy): the first of three where a ranking is sure, the third where it is torn; with fewer than three, the first."""
    if len(names) < 3:
        return profile.select("query_id", F.lit(names[0]).alias("strategy"))
    return profile.select("query_id", F.when(F.col("entropy") < low, names[0]).when(F.col("entropy") > high, names[2]).otherwise(names[1]).alias("strategy"))
