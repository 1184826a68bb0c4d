"""The pipeline's stages against their operators, and its run."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from tarnwood.llm import entries, parity_join, tokens

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def test_stages_keep_columns_and_only_remove(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "repeated_spans", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert out.columns == columns and ids <= before and ids, name
        docs, before = out, ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    whole = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["piece"])):
        whole.setdefault(r["doc_id"], []).extend(r["tokens"])
    assert {i: tokens.decode(t) for i, t in whole.items()} == texts


def test_near_duplicates_meets_one_part_a_task(spark, monkeypatch):
    real = parity_join._meet

    def alone(*args):
        run = real(*args)

        def checked(batches):
            seen = set()

            def watched():
                for b in batches:
                    seen.update(b.column("part").to_pylist())
                    assert len(seen) == 1, seen
                    yield b

            yield from run(watched())

        return checked

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()
    monkeypatch.setattr(parity_join, "_meet", alone)
    got = corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id").collect()
    assert sorted(got) == sorted(want) and got


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_near_groups_and_placement_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    for name, sql in entries.oracle_sql().items():
        got = sorted(map(tuple, entries.queries()[name](spark, SF).collect()))
        want = sorted(con.execute(sql).fetchall())
        assert got == want, name


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entries.queries() if n.startswith("op"))
    assert numbers == list(np.arange(1, 11)) and "pipeline" in entries.queries()
