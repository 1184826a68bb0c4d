"""What is scored, counted and learned where the documents are, against the joins and the plain ways."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwood.operators import bpe, embed, fragments, fusion, geometry, hashed, pmi, rankers, scan, strategies, textrank, topology
from tarnwood.operators import lexindex as lx

VARIANTS = ("atire", "plus", "bm25l", "ltd", "dlh13", "pl2", "dph", "dcm", "sab", "sdm", "wsdm")


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("cat", "mouse", "tree", "stone", "wing") for b in ("", "s", "ful", "ly")]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = spark.createDataFrame([(i, text(int(rng.integers(0, 60)))) for i in range(120)], "doc_id long, text string").repartition(5)
    return docs, spark.createDataFrame([(q, text(5)) for q in range(6)], "query_id long, text string")


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_scan_equals_joins(tables):
    docs, asks = tables
    found = rankers.scanned(docs, asks, VARIANTS)
    wide, pool = found.best(7).cache(), asks.select("query_id").crossJoin(docs.where("doc_id % 9 = 0").select("doc_id"))
    given = found.pairs(pool).cache()
    for v in VARIANTS:
        whole = rankers.score(docs, asks, v).cache()
        assert rows(rankers.top(rankers.leg(wide, v), 7)) == rows(rankers.top(whole, 7))
        assert rows(rankers.leg(given, v)) == rows(whole.join(pool, ["query_id", "doc_id"]).select("query_id", "doc_id", "score"))
    sums = rankers.score(docs, asks).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("s2"))
    assert rows(found.sums().where("leg = 'atire'").drop("leg")) == rows(sums)


def test_ids_that_repeat_are_joined(spark, tables):
    docs, asks = tables
    assert rankers.scanned(docs.unionByName(docs.limit(1)), asks, ("atire",)) is None
    assert not scan.unique_ids(docs.unionByName(spark.createDataFrame([(None, "cat")], docs.schema)))


@pytest.mark.parametrize("depth", [1, 40])
def test_ranks_fused_from_a_scan_equal_those_of_all_scores(tables, depth):
    docs, asks = tables
    legs = ("atire", "plus", "dph")
    fused = fusion.rrf_best(rankers.scanned(docs, asks, legs), 10, depth=depth)
    assert rows(rankers.top(fused, 10)) == rows(rankers.top(fusion.rrf(rankers.score_many(docs, asks, legs)), 10))


def test_keyphrases_and_concepts_by_scan(tables):
    docs, asks = tables
    for least in (0.0, 2.0):
        got = strategies.keyphrase(docs, asks, least_entropy=least, k=5)
        assert rows(rankers.top(got, 5)) == rows(rankers.top(strategies.keyphrase(docs, asks, least_entropy=least), 5))
    concepts = strategies.mine_concepts(lx.words(docs), 2, 0.0)
    assert concepts.count()
    assert rows(rankers.top(strategies.with_concepts(docs, asks, concepts, k=5), 5)) == rows(rankers.top(strategies.with_concepts(docs, asks, concepts), 5))


def test_statistics_without_postings(tables):
    own = lx.words(tables[0])
    assert rows(lx.statistics(own)) == rows(lx.build(own).stats)
    assert rows(lx.statistics(own, bigrams=True)) == rows(lx.build(lx.ordered(own)).stats)


def test_text_rank_reads_whole_texts():
    many = ". ".join(f"filler{i} word{i} item{i}" for i in range(300)) + ". cats chase mice daily. mice fear cats daily. cats fear dogs daily"
    assert {i for i, *_ in textrank.rank(many, 3)} == {300, 301, 302}
    long = " ".join(f"token{i}" for i in range(100))
    assert len(textrank.tokens(long)) == 100


def test_text_rank_by_tokens_equals_pairs():
    rng = np.random.default_rng(2)
    sets = [[b"w%d" % x for x in np.unique(rng.integers(0, 90, rng.integers(3, 20)))] for _ in range(60)] + [[b"x", b"y", b"z"]]
    s = rng.random(len(sets))
    assert np.allclose(textrank._dense(sets)(s), textrank._sparse(sets)(s), atol=1e-12)


def test_sketches_of_many_texts_equal_single_ones():
    texts = [b"", "The cat's naïve café x_1".encode(), b"cat cat CAT", b"..."]
    merges = ((b"c", b"a"), (b"ca", b"t"))
    for c in (embed.COMPACT, embed.EncoderConfig(features="all", merges=merges, bounded=True, sketch_dim=64, projection="none", signed_sqrt=True), embed.EncoderConfig(features="word", sketch_dim=64, projection="none")):
        assert (embed.sketches(texts, c) == np.stack([embed.sketch(t, c) for t in texts])).all()


def test_merges_learned_in_spark_equal_those_learned_on_the_driver(spark):
    rng = np.random.default_rng(3)
    counts = {"".join(rng.choice(list("abé"), rng.integers(1, 9))): int(rng.integers(1, 9)) for _ in range(80)} | {"aaaaa": 50, "abab": 7}
    words = spark.createDataFrame(list(counts.items()), "w string, n long").repartition(3)
    assert bpe.learn_from_words(words, 40) == bpe.learn_from_counts({w.encode(): n for w, n in sorted(counts.items())}, 40)


def test_word_vectors_from_products_in_tasks(spark):
    rng = np.random.default_rng(4)
    i, j = np.triu_indices(12)
    w = rng.random(len(i))
    both = [(int(a), int(b), float(x)) for a, b, x in zip(i, j, w)] + [(int(b), int(a), float(x)) for a, b, x in zip(i, j, w) if a != b]
    cells = spark.createDataFrame(sorted(both), "i int, j int, w double")
    x, values = pmi.subspace(pmi.product(cells, 12), 12, 4)
    y, same = pmi.factorise(12, i, j, w, 4)
    assert np.allclose(values, same) and np.allclose(x, y)


def test_counts_by_document_equal_joins(spark, tables):
    docs = tables[0].unionByName(spark.createDataFrame([(500, "née\x00 ab"), (501, None), (502, "ab")], "doc_id long, text string"))
    from tarnwood.functions import text as T

    for bounded, make in ((False, T.byte_ngrams), (True, T.bounded_ngrams)):
        flat = docs.select("doc_id", F.explode(make("text")).alias("gram")).groupBy("gram", "doc_id").agg(F.count("*").alias("n"))
        assert rows(hashed.gram_counts(docs, bounded)) == rows(flat.groupBy("gram").agg(F.count("*").alias("docs"), F.sum("n").alias("n")))
    own = lx.words(docs)
    want = lx.build(lx.unordered(own)).postings.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum("tf").alias("dl"))
    assert rows(hashed.unordered_pairs(own)) == rows(want)
    twice = docs.unionByName(docs.where("doc_id < 3"))
    assert hashed.sketch(twice, 64).groupBy("doc_id", "bucket").count().where("count > 1").count() == 0
    assert rows(hashed.bucket_weights(twice, 64).select("bucket", "df")) == rows(hashed.bucket_weights(docs, 64).select("bucket", "df"))


def test_strongest_pair_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(topology, "BLOCK", 5)
    x = np.random.default_rng(1).standard_normal((40, 6))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    df = spark.createDataFrame([(k % 3 if k else 9, k, [float(v) for v in x[k]]) for k in range(40)], "label int, vec_id long, vec array<double>")
    got = {r["label"]: r["scale"] for r in topology.strongest_of(df, "label", "vec_id").collect()}
    own = {g: [k for k in range(1, 40) if k % 3 == g] for g in range(3)}
    assert got == pytest.approx({g: max(x[a] @ x[b] for a in k for b in k if a < b) for g, k in own.items()})


def test_shapes_where_fragments_are_made(spark):
    docs = spark.createDataFrame([(1, "Cats chase small mice. Mice fear cats daily. Rain fell over hills."), (2, ""), (3, "One two three")], "doc_id long, text string")
    stats, c = lx.statistics(lx.words(docs)), embed.EncoderConfig(features="both", bounded=True, sketch_dim=64, output_dim=16, projection="fwht")
    assert rows(fragments.build(docs, stats, c, "rich", shape=8)) == rows(geometry.doc_topology(fragments.build(docs, stats, c, "rich")))
