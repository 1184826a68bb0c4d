"""The short way in: one encoder and one reranker with the default settings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tarnwood.operators import embed, fragments, geometry, rankers
from tarnwood.operators import lexindex as lx


def dim(config: embed.EncoderConfig = embed.V1_384) -> int:
    return config.dim


def encode(docs: DataFrame, config: embed.EncoderConfig = embed.V1_384) -> DataFrame:
    """(doc_id, vec)."""
    return embed.encode(docs, config)


def rerank(docs: DataFrame, queries: DataFrame, config: embed.EncoderConfig = embed.V1_384) -> DataFrame:
    """(query_id, doc_id, score): BM25, then the geometry of four sentences and two anchors of each document in the pool."""
    frags = fragments.build(docs, lx.build(lx.words(docs)).stats, config, "rich", top=4, terms=8)
    vectors = embed.encode(queries, config, key="query_id")
    return geometry.rerank(rankers.score(docs, queries), queries, docs, vectors, frags)
