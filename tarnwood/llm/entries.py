"""The queries of this folder, one per operator, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary_codes, crf, cross_polytope, importance, packing, parity_join, pieces, placement, spans, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_groups(table(spark, sf_dir, "documents"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.wavelet_shards(table(spark, sf_dir, "documents"))


def op4_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op5_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.identify(table(spark, sf_dir, "documents"))


def op6_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.place(table(spark, sf_dir, "documents"))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.drop_repeated_spans(table(spark, sf_dir, "documents"))


def op8_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_codes.near_groups(table(spark, sf_dir, "embeddings"))


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 asks, against all."""
    return cross_polytope.neighbours(table(spark, sf_dir, "embeddings"), every=50)


def op10_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


NEAR_GROUPS_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') as t from documents where doc_id is not null),
g as (
  select distinct doc_id, unnest(case when len(t) < 3 then [array_to_string(t, ' ')] else list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) end) as x
  from w where len(t) > 0),
n as (select doc_id, count(*) as c from g group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
pair as (
  select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b
  where common.c >= 0.55 * (na.c + nb.c - common.c) - 1e-9),
edge as (select a, b from pair union select b, a from pair),
reach(node, root) as (select a, a from edge union select edge.b, reach.root from reach join edge on edge.a = reach.node)
select node as doc_id, min(root) as keep_id, links from reach join (select a, count(*) as links from edge group by a) on a = node group by node, links"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_ngram_jaccard_join, op2_importance_resampling, op3_wavelet_shards, op4_nbest_pieces, op5_language_crf, op6_hash_tree, op7_sentence_spans, op8_binary_codes, op9_cross_polytope, op10_power_of_two_packing]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": NEAR_GROUPS_SQL, "op6_hash_tree": placement.place_sql()}
