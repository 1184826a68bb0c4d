"""Scale selection on a similarity graph by its 0-dimensional persistence.

Pairs are (query_id, i, j, sim) with i < j. The largest gap of sorted
similarities and the strongest edge are window and group expressions; merges of
a spanning forest run on each query's own pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.session import prepare


def largest_gap(pairs: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, scale): the middle of the widest gap between neighbouring similarities, the first of equals from above; one similarity is its own scale."""
    order = Window.partitionBy(key).orderBy(F.desc("sim"))
    gaps = pairs.select(key, "sim", F.lead("sim").over(order).alias("nxt"), F.row_number().over(order).alias("rn"))
    best = gaps.groupBy(key).agg(F.max_by(F.struct("sim", "nxt"), F.struct(F.when(F.col("nxt").isNotNull(), F.round(F.col("sim") - F.col("nxt"), 12)), -F.col("rn"))).alias("b"), F.max("sim").alias("top"))
    return best.select(key, F.coalesce((F.col("b.sim") + F.col("b.nxt")) / 2, "top").alias("scale"))


def strongest(pairs: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, scale): the strongest edge, which is the most persistent merge since all births are alike."""
    return pairs.groupBy(key).agg(F.max("sim").alias("scale"))


#: Vectors of a block; two blocks meet in a task.
BLOCK = 4_096


def strongest_of(vectors: DataFrame, key: str, name: str) -> DataFrame:
    """``strongest`` of the cosines of all pairs of unit ``vectors(key, name, vec)`` within a key: block by block as matrix products, no pair leaves its task."""
    prepare(vectors.sparkSession)
    n = vectors.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = vectors.join(F.broadcast(n), key).withColumn("b", F.pmod(F.xxhash64(name), F.col("blocks")).cast("int"))
    met = own.select(key, name, "vec", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    met = met.select(key, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), name, "vec", "b")

    def run(table: pa.Table) -> pa.Table:
        x = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        ids, b = np.unique(table.column(name).combine_chunks().to_numpy(zero_copy_only=False), return_inverse=True)[1], table.column("b").to_numpy()
        one, two = np.flatnonzero(b == table.column("i")[0].as_py()), np.flatnonzero(b == table.column("j")[0].as_py())
        best = -np.inf
        for at in range(0, len(one), 512):
            rows = one[at : at + 512]
            s = x[rows] @ x[two].T
            s[ids[rows][:, None] == ids[two][None]] = -np.inf
            best = max(best, s.max(initial=-np.inf))
        return pa.table({key: table.column(key).slice(0, 1), "sim": pa.array([best])})

    kind = vectors.schema[key].dataType.simpleString()
    per = met.groupBy(key, "i", "j").applyInArrow(run, f"{key} {kind}, sim double")
    return strongest(per.where(F.col("sim") > float("-inf")), key)


def keep_edges(pairs: DataFrame, scales: DataFrame, key: str = "query_id") -> DataFrame:
    """The pairs at or above their query's scale; a scale of 0 or less keeps all."""
    return pairs.join(scales, key).where((F.col("scale") <= 0) | (F.col("sim") >= F.col("scale"))).drop("scale")


def merge_levels(i: np.ndarray, j: np.ndarray, sim: np.ndarray, n: int) -> np.ndarray:
    """The similarities at which components merge, falling: the weights of a maximum spanning forest."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for e in np.lexsort((j, i, -sim)):
        a, b = find(int(i[e])), find(int(j[e]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(sim[e])
            if len(out) == n - 1:
                break
    return np.array(out)


def deaths(pairs: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, k, death): the merges of each query, from the strongest."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.r_[group["i"], group["j"]])
        d = merge_levels(np.searchsorted(names, group["i"]), np.searchsorted(names, group["j"]), group["sim"].to_numpy(), len(names))
        return pd.DataFrame({key: group[key].iloc[0], "k": np.arange(len(d)), "death": d})

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.groupBy(key).applyInPandas(run, f"{key} {kind}, k int, death double")


def select_scale(d: np.ndarray, criterion: str = "largest_gap") -> float:
    """The scale from merges in falling order: the middle of their widest gap, the strongest, or the sharpest bend."""
    d = np.sort(np.asarray(d, float))[::-1]
    if not len(d):
        return 0.0
    if criterion == "max_persistence":
        return float(d[0])
    if criterion == "elbow":
        if len(d) < 3:
            return float(d[0])
        return float(d[1 + int(np.argmax(np.abs(d[:-2] - 2 * d[1:-1] + d[2:])))])
    if len(d) == 1:
        return float(d[0])
    k = int(np.argmax(np.round(d[:-1] - d[1:], 12)))
    return float((d[k] + d[k + 1]) / 2)


def scale_of(sims: np.ndarray, criterion: str = "approx") -> float:
    """The scale of an upper triangle given as a square matrix's pairs."""
    n = len(sims)
    if n < 2:
        return 0.0
    i, j = np.triu_indices(n, 1)
    if criterion == "approx":
        return select_scale(sims[i, j], "largest_gap")
    return select_scale(merge_levels(i, j, sims[i, j], n), criterion)


def diagram(i: np.ndarray, j: np.ndarray, sim: np.ndarray, n: int) -> list[tuple[float, float, list[int]]]:
    """(birth, death, points) of every component: those that merge into an older one, and the survivors, whose death is infinite."""
    root, held, out = list(range(n)), {k: [k] for k in range(n)}, []

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for e in np.lexsort((j, i, -sim)):
        a, b = sorted((find(int(i[e])), find(int(j[e]))))
        if a != b:
            out.append((1.0, float(sim[e]), sorted(held[b])))
            held[a] += held.pop(b)
            root[b] = a
    return out + [(1.0, float("inf"), sorted(p)) for p in held.values()]


def diagrams(pairs: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, birth, death, points): the components of each query's pairs; points are the names in ``i`` and ``j``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.r_[group["i"], group["j"]])
        found = diagram(np.searchsorted(names, group["i"]), np.searchsorted(names, group["j"]), group["sim"].to_numpy(), len(names))
        return pd.DataFrame({key: group[key].iloc[0], "birth": [b for b, *_ in found], "death": [d for _, d, _ in found], "points": [names[p].tolist() for *_, p in found]})

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.groupBy(key).applyInPandas(run, f"{key} {kind}, birth double, death double, points array<long>")


def elbow(levels: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, scale) from ``deaths``: where the second difference is greatest; the first with fewer than three."""
    order = Window.partitionBy(key).orderBy("k")
    bent = levels.select(key, "k", "death", F.abs(F.lag("death").over(order) - 2 * F.col("death") + F.lead("death").over(order)).alias("bend"))
    best = bent.groupBy(key).agg(F.max_by("death", F.struct(F.when(F.col("bend").isNotNull(), F.round("bend", 12)), -F.col("k"))).alias("at"), F.max_by("death", -F.col("k")).alias("first"), F.count("*").alias("n"))
    return best.select(key, F.when(F.col("n") >= 3, F.col("at")).otherwise(F.col("first")).alias("scale"))
