"""Retrieval fixtures: TSV folders, BEIR folders, vector files, and JSON-lines results."""

from __future__ import annotations

import re
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, VERSION = b"TARNVEC1", 1


def read_tsv(spark: SparkSession, path: str, names: tuple[str, str]) -> DataFrame:
    """Two columns split at the first tab only, so that a text may hold tabs."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).where("value <> ''")
    return rows.select(parts[0].alias(names[0]), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias(names[1]))


def load(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a fixture folder; ``test`` has no suffix. Judgments are checked, see ``validate``."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", split):
        raise ValueError("a split is named by letters, digits, - and _")
    end = "" if split == "test" else f"_{split}"
    corpus = read_tsv(spark, f"{folder}/corpus.tsv", ("doc_id", "text"))
    queries = read_tsv(spark, f"{folder}/queries{end}.tsv", ("query_id", "text"))
    raw = F.split("value", "\t")
    qrels = spark.read.text(f"{folder}/qrels{end}.tsv").where("value <> ''").select(raw[0].alias("query_id"), raw[1].alias("doc_id"), raw[2].cast("int").alias("relevance"))
    validate(corpus, queries, qrels)
    return corpus, queries, qrels


def validate(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> None:
    """Errors: repeated ids, unknown ids in judgments, repeated positive judgments, nothing to evaluate."""
    for df, key in ((corpus, "doc_id"), (queries, "query_id")):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"a {key} occurs twice")
    gold = qrels.where("relevance > 0")
    if not gold.limit(1).count() or not corpus.limit(1).count() or not queries.limit(1).count():
        raise ValueError("a fixture needs a document, a query and a positive judgment")
    if gold.groupBy("query_id", "doc_id").count().where("count > 1").limit(1).count():
        raise ValueError("a positive judgment occurs twice")
    if qrels.join(corpus, "doc_id", "left_anti").limit(1).count() or qrels.join(queries, "query_id", "left_anti").limit(1).count():
        raise ValueError("a judgment names an unknown id")


def read_beir(spark: SparkSession, folder: str, dev: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a BEIR folder: title and text in one, tabs and line breaks as spaces; dev judgments, else those of train."""
    from pathlib import Path

    clean = lambda c: F.trim(F.regexp_replace(c, r"[\t\r\n]+", " "))
    raw = spark.read.json(f"{folder}/corpus.jsonl")
    title = F.coalesce("title", F.lit("")) if "title" in raw.columns else F.lit("")
    corpus = raw.select(F.col("_id").cast("string").alias("doc_id"), clean(F.concat_ws(" ", F.nullif(title, F.lit("")), "text")).alias("text"))
    asked = spark.read.json(f"{folder}/queries.jsonl").select(F.col("_id").cast("string").alias("query_id"), clean(F.col("text")).alias("text"))
    name = "test"
    if dev:
        name = "dev" if Path(folder, "qrels/dev.tsv").exists() else "train"
    gold = spark.read.csv(f"{folder}/qrels/{name}.tsv", sep="\t", header=True)
    qrels = gold.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), F.col("score").cast("int").alias("relevance"))
    return corpus, asked.join(qrels.select("query_id").distinct(), "query_id", "left_semi"), qrels


def write_tsv(df: DataFrame, path: str) -> None:
    """Columns joined by tabs; Spark's committer shows the folder when it is whole."""
    df.select(F.concat_ws("\t", *df.columns).alias("value")).write.text(path)


def write_results(rows: DataFrame, path: str) -> None:
    """JSON lines."""
    rows.write.json(path)


def pack_vectors(model: str, queries: np.ndarray, docs: np.ndarray) -> bytes:
    """One binary of the two float matrices of a dense reference."""
    name = model.encode()
    head = struct.pack("<IIIII", VERSION, docs.shape[1], len(queries), len(docs), len(name))
    return MAGIC + head + name + queries.astype("<f4").tobytes() + docs.astype("<f4").tobytes()


def unpack_vectors(data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    if data[:8] != MAGIC:
        raise ValueError("not a vector file")
    version, dim, nq, nd, n = struct.unpack("<IIIII", data[8:28])
    if version != VERSION or len(data) != 28 + n + 4 * dim * (nq + nd):
        raise ValueError("a vector file of another version or size")
    flat = np.frombuffer(data[28 + n :], "<f4").reshape(nq + nd, dim)
    return data[28 : 28 + n].decode(), flat[:nq], flat[nq:]


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(side, idx, vec) of the vector files at a path, read by the executors."""
    import pyarrow as pa

    from tarnwood.session import prepare

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                _, q, d = unpack_vectors(raw)
                for side, x in (("query", q), ("doc", d)):
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([side] * len(x)), pa.array(np.arange(len(x), dtype=np.int32)), vec], names=["side", "idx", "vec"])

    return prepare(spark).read.format("binaryFile").load(path).select("content").mapInArrow(run, "side string, idx int, vec array<float>")
