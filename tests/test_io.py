from __future__ import annotations

import json

import numpy as np
import pytest

from tarnwood.operators import lexindex as lx
from tarnwood.sources import fixtures
from tarnwood.streaming import ingest


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.tsv").write_text(text)


def test_fixture(spark, tmp_path):
    write(tmp_path, corpus="d1\ta\tb\nd2\tc\n", queries="q1\tx\n", qrels="q1\td1\t1\n")
    corpus, _, qrels = fixtures.load(spark, str(tmp_path))
    assert {tuple(r) for r in corpus.collect()} == {("d1", "a\tb"), ("d2", "c")}
    assert qrels.first()["relevance"] == 1
    for bad in ("q1\td9\t1\n", "q1\td1\t1\nq1\td1\t2\n", "q1\td1\t0\n"):
        write(tmp_path, qrels=bad)
        with pytest.raises(ValueError):
            fixtures.load(spark, str(tmp_path))
    with pytest.raises(ValueError):
        fixtures.load(spark, str(tmp_path), "../x")


def test_beir(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text(json.dumps({"_id": "1", "title": "T", "text": "a\tb\nc"}) + "\n")
    (tmp_path / "queries.jsonl").write_text(json.dumps({"_id": "q", "text": "x"}) + "\n" + json.dumps({"_id": "r", "text": "y"}) + "\n")
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t1\n")
    corpus, queries, _ = fixtures.read_beir(spark, str(tmp_path))
    assert corpus.first()["text"] == "T a b c" and queries.count() == 1


def test_vector_file(spark, tmp_path):
    q, d = np.ones((2, 3), np.float32), np.zeros((4, 3), np.float32)
    data = fixtures.pack_vectors("m", q, d)
    name, a, b = fixtures.unpack_vectors(data)
    assert name == "m" and (a == q).all() and (b == d).all()
    with pytest.raises(ValueError):
        fixtures.unpack_vectors(data[:-1])
    (tmp_path / "v.bin").write_bytes(data)
    assert fixtures.read_vectors(spark, str(tmp_path / "v.bin")).groupBy("side").count().count() == 2


def test_streamed_index_equals_the_whole(spark, tmp_path):
    src, schema = tmp_path / "src", "doc_id long, text string"
    spark.createDataFrame([(1, "a b a"), (2, "b c")], schema).write.parquet(str(src))
    path, check = str(tmp_path / "index"), str(tmp_path / "check")
    ingest.index_stream(spark.readStream.schema(schema).parquet(str(src)), path, check).awaitTermination()
    spark.createDataFrame([(3, "c c d"), (4, "")], schema).write.mode("append").parquet(str(src))
    ingest.index_stream(spark.readStream.schema(schema).parquet(str(src)), path, check).awaitTermination()
    whole = lx.build(lx.words(spark.read.parquet(str(src))))
    got = ingest.read_index(spark, path)
    assert sorted(map(tuple, got.stats.collect())) == sorted(map(tuple, whole.stats.collect()))
    assert got.corpus.first() == whole.corpus.first()
