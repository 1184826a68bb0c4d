"""Queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tarnwood.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
CHECKED = ["lead_tokens", "entities", "sentence_tokens", "term_stats", "gram_stats_pruned", "bm25_atire", "bm25_sab", "wsdm", "bm25f_lead", "rm3", "convex_z", "query_features_post", "route", "keyphrase_boost", "concepts", "ppmi", "signature_overlap", "largest_gap", "cosine_topk", "pq_encode_fixed", "cluster_separation", "eval_trec", "splitmix_sketch", "latency_summary"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(df):
    def value(v):
        v = v.item() if hasattr(v, "item") else v
        return (None if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v

    df = df[sorted(df.columns)]
    return sorted((tuple(value(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_statement_has_a_query():
    assert catalog.oracle_sql().keys() <= catalog.queries().keys()
    assert len(catalog.queries()) > 100
