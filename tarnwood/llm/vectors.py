"""What the two vector operators share: usable rows, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, d): rows with an id and a finite vector that isn't all zero, of length d; rows that repeat both count once, and of unlike vectors with one id the least stays."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))


def matrix(column) -> np.ndarray:
    """A list column of equally long lists as an array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def dimensions(rows: DataFrame) -> list[tuple[int, int]]:
    """(length, number of vectors), for each length there is."""
    return sorted((r["d"], r["n"]) for r in rows.groupBy("d").agg(F.count("*").alias("n")).collect())
