"""Pseudo-relevance feedback: relevance models and RM3, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.session import keep

from . import lexindex as lx
from . import rankers
from .rankers import DEFAULT, Params


def feedback_docs(scores: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, w): the k best documents with a positive score, weighted by their share of the scores."""
    best = rankers.top(scores.where("score > 0"), k)
    return normalised(best.select("query_id", "doc_id", F.col("score").alias("w")))


def normalised(given: DataFrame) -> DataFrame:
    """Explicit feedback (query_id, doc_id, w): weights of 0 or less go, the rest add up to 1."""
    live = given.where("w > 0")
    return live.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("query_id")))


def relevance_model(rows: DataFrame, feedback: DataFrame) -> DataFrame:
    """RM1, (query_id, term, weight): the sum over feedback documents of tf / dl * w. Only these documents' terms are counted."""
    once = feedback.groupBy("query_id", "doc_id").agg(F.first("w").alias("w"))
    of = rows.join(once.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    tf = of.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    return tf.join(once, "doc_id").groupBy("query_id", "term").agg(F.sum(F.col("tf") / F.col("dl") * F.col("w")).alias("weight"))


def strongest(model: DataFrame, n: int = 20) -> DataFrame:
    """The n heaviest terms of each query (equal weights by term), scaled to add up to 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("weight", 12)), "term")
    kept = model.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    return kept.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("query_id"))).drop("rn")


def expanded(asked: DataFrame, model: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(query_id, term, qtf): (1 - alpha) * the query's own term shares + alpha * the model."""
    total = asked.select("query_id", F.size("terms").alias("n"))
    own = lx.query_terms(asked).join(total, "query_id").select("query_id", "term", (F.lit(1 - alpha) * F.col("qtf") / F.col("n")).alias("qtf"))
    more = model.select("query_id", "term", (F.lit(alpha) * F.col("weight")).alias("qtf"))
    return own.unionByName(more).groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))


def rm3(docs: DataFrame, queries: DataFrame, k: int = 10, n_terms: int = 20, alpha: float = 0.5, variant: str = "atire", p: Params = DEFAULT, feedback: DataFrame | None = None, best: int | None = None, pool: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): RM3 from the first pass, or from explicit ``feedback(query_id, doc_id, w)``.

    A query without feedback, or alpha 0, keeps its first-pass scores. With
    ``best`` only documents that can be among so many best of a query have rows,
    with a ``pool(query_id, doc_id)`` beside explicit feedback only its pairs.
    """
    found = rankers.scanned(docs, queries, (variant,), p) if best is not None or pool is not None else None
    of = (lambda scan, k: scan.best(k)) if pool is None else (lambda scan, k: scan.pairs(pool))
    first = rankers.score(docs, queries, variant, p) if found is None else keep(rankers.leg(of(found, max(best or 0, k)), variant), "first")
    if alpha <= 0 or n_terms == 0 or (feedback is None and k == 0):
        return first
    rows, asked = lx.words(docs), lx.query_words(queries)
    used = feedback_docs(first, k) if feedback is None else normalised(feedback)
    # a few terms a query, read three times below
    model = keep(strongest(relevance_model(rows, used), n_terms), "feedback")
    helped = model.select("query_id").distinct()
    more = expanded(asked.join(helped, "query_id", "left_semi"), model, alpha)
    if found is not None:
        own = {"sab": "plus", "layered": "atire", "layered_w": "atire"}.get(variant, variant)
        found = rankers.scanned(docs, queries, (), p, terms={"again": more}, terms_variant=own)
    again = rankers.score_terms(rows, more, variant, p) if found is None else rankers.leg(of(found, best), "again")
    return again.unionByName(first.join(helped, "query_id", "left_anti"))


def terms_for_clarity(clarity: Column, least: int = 5, most: int = 50, low: float = 0.5, high: float = 5.0) -> Column:
    """How many expansion terms a query of this clarity gets: linear between two bounds, rounded half up."""
    if most <= least or high <= low:
        return F.lit(least)
    share = (clarity - low) / (high - low)
    return F.when(clarity <= low, least).when(clarity >= high, most).otherwise(F.floor(least + share * (most - least) + 0.5)).cast("int")
