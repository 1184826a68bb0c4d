"""Ranking metrics and analyses over (query_id, doc_id, score) and (query_id, doc_id, relevance)."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.functions import vectors as V
from tarnwood.session import keep, prepare

from . import fusion, rankers


def metrics(ranking: DataFrame, qrels: DataFrame, capped: bool = False) -> DataFrame:
    """One row a query with a positive judgment: ndcg10 with linear gain, p10, r10, r100, mrr10.

    Recall is over all relevant documents, or with ``capped`` over at most as
    many as the cut. Scores that aren't finite are left out.
    """
    gold = qrels.where("relevance > 0").select("query_id", "doc_id", F.col("relevance").cast("double").alias("g"))
    n_rel = gold.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("g"), "doc_id"))
    ideal = gold.withColumn("r", ideal_rank).where("r <= 10").groupBy("query_id").agg(F.sum(F.col("g") / F.log2(F.col("r") + 1.0)).alias("ideal"))
    best = rankers.top(fusion.finite(ranking), 100)
    hits = best.join(gold, ["query_id", "doc_id"])
    inside = lambda k: F.sum(F.when(F.col("rank") <= k, 1).otherwise(0))
    per = hits.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= 10, F.col("g") / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        inside(10).alias("h10"),
        inside(100).alias("h100"),
        F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"),
    )
    out = n_rel.join(ideal, "query_id").join(per, "query_id", "left").fillna(0, ["dcg", "h10", "h100"])
    over = lambda k: F.least(F.lit(k), F.col("n_rel")) if capped else F.col("n_rel")
    return out.select(
        "query_id",
        (F.col("dcg") / F.col("ideal")).alias("ndcg10"),
        (F.col("h10") / 10).alias("p10"),
        (F.col("h10") / over(10)).alias("r10"),
        (F.col("h100") / over(100)).alias("r100"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr10"),
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(*[F.avg(c).alias(c) for c in names], F.count("*").alias("queries"))


def candidate_recall(pool: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, recall): the share of a query's relevant documents that are in its pool."""
    gold = qrels.where("relevance > 0").select("query_id", "doc_id").distinct()
    found = gold.join(pool.select("query_id", "doc_id", F.lit(1).alias("hit")).distinct(), ["query_id", "doc_id"], "left")
    return found.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def union_recall(lists: DataFrame, qrels: DataFrame, depth: int = 100) -> DataFrame:
    """(query_id, recall) of the union of several lists' best documents."""
    return candidate_recall(fusion.pool_union(lists, depth), qrels)


#: Queries that are shared at once, and the sides of the blocks in which products are taken.
QUERY_BLOCK, TILE = 20_000, 2_048


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


def exact_dense(queries: DataFrame, docs: DataFrame, k: int, vec: str = "vec") -> DataFrame:
    """(query_id, rank, doc_id, score): the documents with the greatest dot products.

    Queries are shared with the tasks in blocks of ``QUERY_BLOCK``, each of which
    is one pass over the documents; tasks keep the k best of each of their tiles,
    and one window merges them.
    """
    spark = prepare(docs.sparkSession)
    kinds = queries.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"

    def found(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r[0] for r in block], np.array([r[1] for r in block], np.float64)))

        def run(batches):
            ids, q = shared.value
            ids = pa.array(ids)
            for whole in batches:
                for at in range(0, whole.num_rows if len(q) else 0, TILE):
                    b = whole.slice(at, TILE)
                    b = b.take(pc.sort_indices(b.column(0)))
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    for c in range(0, len(q), TILE):
                        s = q[c : c + TILE] @ x.T
                        i, j = nearest(np.round(s, 8), k)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(c + i)), b.column(0).take(pa.array(j)), pa.array(s[i, j])], names=["query_id", "doc_id", "score"])

        return docs.select("doc_id", vec).mapInArrow(run, schema)

    rows, out = queries.select("query_id", vec).toLocalIterator(), None
    while True:
        block = list(itertools.islice(rows, QUERY_BLOCK))
        if out is not None and not block:
            break
        part = rankers.top(found(block), k)
        if out is None and len(block) < QUERY_BLOCK:
            return part
        # what is written needs its block no more, so the driver holds one at a time
        part = keep(part, "nearest")
        out = part if out is None else out.unionByName(part)
    return out


def cluster_separation(vectors: DataFrame, label: str = "label", vec: str = "vec") -> DataFrame:
    """(label, n, intra, inter): mean cosines within a label and to all others, from sums of unit vectors, not from pairs."""
    u = vectors.select(label, F.posexplode(V.l2_normalize(F.col(vec))).alias("dim", "x"))
    sums = u.groupBy(label, "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    everything = sums.groupBy("dim").agg(F.sum("s").alias("t"))
    n = vectors.groupBy(label).agg(F.count("*").alias("n"))
    per = sums.join(F.broadcast(everything), "dim").groupBy(label).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"), F.sum(F.col("s") * (F.col("t") - F.col("s"))).alias("st"))
    total = n.agg(F.sum("n").alias("total"))
    m = F.col("n")
    return per.join(n, label).crossJoin(F.broadcast(total)).select(label, "n", F.when(m > 1, (F.col("ss") - F.col("q")) / (m * (m - 1))).alias("intra"), F.when(F.col("total") > m, F.col("st") / (m * (F.col("total") - m))).alias("inter"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name) of each distinct value: the average of the ranks of its rows.

    Counts of values are sorted by ranges; ranks add up inside each range, and a
    row a range carries them on, so no task holds all values.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("__n")).orderBy(column).withColumn("__p", F.spark_partition_id())
    counts = keep(counts, "ranks")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("__p").agg(F.sum("__n").alias("__s")).select("__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("__p").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("__c", F.sum("__n").over(inside)).join(F.broadcast(ranges), "__p").select(column, (F.col("__o") + F.col("__c") - (F.col("__n") - 1) / 2).alias(name))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the rank correlation of two columns, ties at their average rank; rows with a null in either are left out."""
    pairs = df.select(F.col(a).alias("__x"), F.col(b).alias("__y")).where("__x is not null and __y is not null")
    # ranks join on the values: sums made anew may differ in their last bits, and those rows would be lost
    pairs = keep(pairs, "pairs")
    ranked = pairs.join(average_ranks(pairs, "__x", "__a"), "__x").join(average_ranks(pairs, "__y", "__b"), "__y")
    return ranked.agg(F.corr("__a", "__b").alias("rho"), F.count("*").alias("n"))


def latency_summary(times: DataFrame, value: str = "us", by: str = "variant") -> DataFrame:
    """(by, mean, p50, p95): nearest-rank percentiles, the values at rank ceil(p * n), counted by value and not sorted as rows."""
    kind = times.schema[value].dataType
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by {value})").cast(kind)
    return times.groupBy(by).agg(F.avg(value).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))
