"""Identities, hand-computed values and brute force."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwood import api
from tarnwood.operators import bpe, dictmatch, embed, evaluate, experiments, feedback, fragments, fusion, geometry, minhash, pmi, pq, rankers, routing, strategies, textrank, topology
from tarnwood.operators import lexindex as lx

DOCS = [(1, "the quick brown fox jumps over the lazy dog"), (2, "a quick quick fox"), (3, "lazy dogs sleep all day"), (4, None), (5, ""), (6, "Fox and dog, dog and fox")]
ASKS = [(1, "quick fox fox"), (2, "lazy dog"), (3, "unicorn")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def asks(spark):
    return spark.createDataFrame(ASKS, "query_id long, text string").cache()


def table(df):
    return {(r["query_id"], r["doc_id"]): round(r["score"], 9) for r in df.collect()}


def test_index(docs):
    i = lx.build(lx.words(docs))
    corpus = i.corpus.first()
    assert (corpus["n"], corpus["total"]) == (6, 24)
    fox = i.stats.where("term = 'fox'").first()
    assert (fox["df"], fox["ttf"]) == (3, 4) and math.isclose(fox["idf"], math.log(3.5 / 3.5 + 1))
    assert {r["term"]: r["df"] for r in i.lookup(docs.sparkSession.createDataFrame([("FOX",), ("none",)], "term string")).collect()} == {"FOX": 3, "none": 0}


def test_index_is_saved_and_read(spark, docs, tmp_path):
    i = lx.build(lx.words(docs))
    i.save(str(tmp_path / "index"))
    again = lx.LexIndex.load(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, again.stats.collect())) == sorted(map(tuple, i.stats.collect()))


def test_reductions(docs, asks):
    p = rankers.Params
    base = table(rankers.score(docs, asks))
    assert base and all(k[0] != 3 for k in base)
    assert table(rankers.score(docs, asks, "plus", p(delta=0))) == base
    assert table(rankers.score(docs, asks, "ltd", p(ltd_alpha=1))) == base
    assert table(rankers.score(docs, asks, "sdm", p(unigram=1, ordered=0, unordered=0))) == base
    assert table(rankers.score(docs, asks, "wsdm", p(beta=0))) == table(rankers.score(docs, asks, "sdm"))
    rows, asked = lx.words(docs), lx.query_words(asks)
    assert table(rankers.fields(rows, lx.lead_field(docs), asked, asked, 1, 0)) == base
    plus, sab = table(rankers.score(docs, asks, "plus")), table(rankers.score(docs, asks, "sab", p(gamma=0)))
    assert {k: v for k, v in sab.items() if k[0] != 3} == plus
    assert table(feedback.rm3(docs, asks, alpha=0)) == base
    assert table(strategies.with_concepts(docs, asks, None, 0)) == base


def test_ordered_pairs_prefer_the_order(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta alpha gamma")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha beta")], "query_id long, text string")
    s = table(rankers.score(d, q, "sdm"))
    assert s[1, 1] > s[1, 2]


def test_top_with_unmatched(docs, asks):
    s = rankers.score(docs, asks)
    want = rankers.top(rankers.dense(s, asks, docs), 4)
    assert sorted(map(tuple, rankers.top_dense(s, asks, docs, 4).collect())) == sorted(map(tuple, want.select("query_id", "rank", "doc_id", "score").collect()))


def test_relevance_model_counts_feedback_only(docs, asks):
    fb = feedback.feedback_docs(rankers.score(docs, asks), 2)
    assert all(math.isclose(r["w"], 1) for r in fb.groupBy("query_id").agg(F.sum("w").alias("w")).collect())
    m = feedback.strongest(feedback.relevance_model(lx.words(docs), fb), 3)
    assert all(r["n"] == 3 and math.isclose(r["w"], 1) for r in m.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect())


def test_clarity_terms(spark):
    got = [r[0] for r in spark.createDataFrame([(0.1,), (2.75,), (9.0,)], "c double").select(feedback.terms_for_clarity(F.col("c"))).collect()]
    assert got == [5, 28, 50]


def lists(spark, **legs):
    return spark.createDataFrame([(leg, 1, d, float(s)) for leg, rows in legs.items() for d, s in rows], "leg string, query_id long, doc_id long, score double")


def test_fusion(spark):
    swapped = lists(spark, a=[(0, 2), (1, 1)], b=[(0, 1), (1, 2)])
    got = table(fusion.rrf(swapped))
    assert got[1, 0] == got[1, 1] == round(1 / 61 + 1 / 62, 9)
    blend = table(fusion.convex_z(lists(spark, a=[(0, 0), (1, 1)], b=[(0, 2), (1, 0)]), {"a": 0.75, "b": 0.25}))
    assert math.isclose(blend[1, 0], -0.5, abs_tol=1e-6) and math.isclose(blend[1, 1], 0.5, abs_tol=1e-6)
    z = table(fusion.convex_z(lists(spark, a=[(i, i + 1) for i in range(4)]), {"a": 1.0}))
    assert all(math.isclose(z[1, i], (i + 1 - 2.5) / math.sqrt(1.25), abs_tol=1e-6) for i in range(4))
    assert table(fusion.comb_sum(lists(spark, a=[(0, 1), (1, 1)]))) == {(1, 0): 0.0, (1, 1): 0.0}


def test_scales(spark):
    pairs = lambda *s: spark.createDataFrame([(1, i, j, x) for (i, j), x in zip([(0, 1), (0, 2), (1, 2)], s)], "query_id long, i int, j int, sim double")
    assert math.isclose(topology.largest_gap(pairs(0.9, 0.5, 0.5)).first()["scale"], 0.7)
    assert math.isclose(topology.largest_gap(pairs(0.8, 0.8, 0.8)).first()["scale"], 0.8)
    assert math.isclose(topology.largest_gap(pairs(0.6)).first()["scale"], 0.6)
    assert topology.strongest(pairs(0.9, 0.5, 0.5)).first()["scale"] == 0.9
    assert [r["death"] for r in topology.deaths(pairs(0.9, 0.5, 0.5)).orderBy("k").collect()] == [0.9, 0.5]
    two = np.full((6, 6), 0.3)
    two[:3, :3] = two[3:, 3:] = 0.95
    assert math.isclose(topology.scale_of(two, "largest_gap"), 0.625) and math.isclose(topology.scale_of(two), 0.625)
    assert topology.scale_of(np.ones((1, 1))) == 0.0
    assert topology.select_scale(np.array([0.9, 0.5]), "elbow") == 0.9
    spans = topology.diagram(np.array([0, 0, 1]), np.array([1, 2, 2]), np.array([0.9, 0.5, 0.4]), 3)
    assert [d for _, d, _ in spans] == [0.9, 0.5, math.inf] and spans[-1][2] == [0, 1, 2]


def test_metrics(spark):
    rank = spark.createDataFrame([(1, d, float(10 - d)) for d in range(5)] + [(2, 0, 1.0)], "query_id long, doc_id long, score double")
    gold = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (2, 9, 0)], "query_id long, doc_id long, relevance int")
    rows = evaluate.metrics(rank, gold).collect()
    assert len(rows) == 1 and math.isclose(rows[0]["ndcg10"], (1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert (rows[0]["p10"], rows[0]["r10"], rows[0]["mrr10"]) == (0.2, 1.0, 1.0)
    assert evaluate.candidate_recall(rank.where("doc_id = 1"), gold).first()["recall"] == 0.5


def test_separation_equals_pairs(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((12, 4))
    label = [i % 3 for i in range(12)]
    got = {r["label"]: r for r in evaluate.cluster_separation(spark.createDataFrame([(l, [float(v) for v in r]) for l, r in zip(label, x)], "label int, vec array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    for c in range(3):
        own = [i for i in range(12) if label[i] == c]
        other = [i for i in range(12) if label[i] != c]
        assert math.isclose(got[c]["intra"], np.mean([s[i, j] for i in own for j in own if i != j]))
        assert math.isclose(got[c]["inter"], np.mean([s[i, j] for i in own for j in other]))


def test_routing(spark, docs, asks):
    f = {r["query_id"]: r for r in routing.features(docs, asks).collect()}
    assert f[3]["oov_rate"] == 1.0 and f[1]["n_terms"] == 3
    got = {r["query_id"]: r["recipe"] for r in routing.choose(routing.features(docs, asks)).collect()}
    assert got[3] == "sab"
    half = spark.createDataFrame([(1, "blockchain dog")], "query_id long, text string")
    assert routing.features(docs, half).first()["oov_rate"] == 0.5


def test_concepts(spark):
    other = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota", "kappa lambda mu"]
    d = spark.createDataFrame([(i, f"time value money {other[i]}") for i in range(3)] + [(3, other[3])], "doc_id long, text string")
    got = {r["term"]: r for r in strategies.mine_concepts(lx.words(d), 3, 0.1).collect()}
    assert got["time value"]["ttf"] == 3 and got["time value"]["df"] == 3 and got["time value"]["pmi"] > 0


def test_dictionary():
    own = dictmatch.compile_patterns([(0, "value", 7), (1, "time value", 8)])
    assert dictmatch.match(own, "the time value of money") == [(1, 4, 14, 8)]
    assert [h[0] for h in dictmatch.match(own, "Time VALUE", longest=False)] == [1, 0]
    she = dictmatch.compile_patterns([(0, "she", None), (1, "he", None), (2, "hers", None)])
    assert len(dictmatch.match(she, "ushers", whole_word=False, longest=False)) == 3
    assert dictmatch.match(she, "ushers") == []
    cafe = dictmatch.compile_patterns([(0, "café", None)])
    assert dictmatch.match(cafe, "au café.") == [(0, 3, 8, None)]
    assert dictmatch.match(cafe, "cafés") == []
    with pytest.raises(ValueError):
        dictmatch.compile_patterns([(0, "", None)])


def test_dictionary_by_join(spark, docs):
    p = spark.createDataFrame([(1, "quick fox"), (2, "dog"), (3, "")], "pattern_id long, pattern string")
    assert sorted(map(tuple, dictmatch.word_dictionary(docs, p).collect())) == [(1, 2, 1), (2, 1, 1), (6, 2, 2)]


def test_merges():
    counts = {b"low": 5, b"lower": 2, b"newest": 6, b"widest": 3}
    m = bpe.learn_from_counts(counts, 14)
    assert m[:2] == [(b"e", b"s"), (b"es", b"t")]
    rank = {p: i for i, p in enumerate(m)}
    assert all(b"".join(bpe.apply_word(w, rank)) == w for w in [*counts, b"unseen\xff"])
    assert bpe.from_text(bpe.to_text([*m, (b"\\", b"\x00 ")])) == [*m, (b"\\", b"\x00 ")]
    assert bpe.from_text("nothing\na\\q\tb\n") == []


def test_merges_in_spark(spark, docs):
    m = bpe.learn(docs, 40)
    rows = bpe.subwords(docs, m).collect()
    assert rows and all(b"".join(bytes(x) for x in r["pieces"]).decode() == r["word"] for r in rows)


def test_textrank():
    assert textrank.rank("") == [] and textrank.rank("One two three")[0][2] == 1.0
    got = textrank.rank("Cats chase small mice. Mice fear cats daily. Rain fell over hills. Nothing else matters here.")
    assert {got[0][0], got[1][0]} == {0, 1}


def test_minhash(spark):
    a, b = b"the quick brown fox jumps", b"the quick brown fox jumped"
    grams = lambda t: {t[i : i + k] for k in (3, 4, 5) for i in range(len(t) - k + 1)}
    true = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    est = np.mean([np.mean(minhash.densify(minhash.bin_minima(a, 64, seed=s), s) == minhash.densify(minhash.bin_minima(b, 64, seed=s), s)) for s in range(40)])
    assert abs(est - true) < 0.06
    df = minhash.signatures(spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string"), 16)
    assert [len(r["signature"]) for r in df.collect()] == [16, 16]


def test_encoder(spark, docs):
    for mode in embed.PROJECTIONS:
        c = embed.EncoderConfig(sketch_dim=256, output_dim=64, projection=mode)
        v = embed.encode_texts(["hello world", "hello there", None], c)
        assert v.shape == (3, c.dim) and np.allclose(np.linalg.norm(v[:2], axis=1), 1) and not v[2].any()
    x = np.random.default_rng(0).standard_normal((50, 256))
    for mode in ("achlioptas", "gaussian", "very_sparse", "sparse_jl", "fwht"):
        y = embed.project(x, embed.EncoderConfig(sketch_dim=256, output_dim=128, projection=mode))
        assert abs(np.mean((y**2).sum(1) / (x**2).sum(1)) - 1) < 0.15
    assert len(api.encode(docs).first()["vec"]) == api.dim() == 384
    with pytest.raises(ValueError):
        embed.EncoderConfig(projection="fwht", sketch_dim=4, output_dim=8)


def test_document_weights(docs):
    c = embed.EncoderConfig(features="word", fold=True)
    idf = embed.learn_idf(docs, c, 1024)
    assert idf.documents == 6 and idf.weights.max() == round(1024 * math.log(7 / 0.5))
    again = embed.HashedIdf.from_bytes(idf.to_bytes())
    assert again.fingerprint() == idf.fingerprint() and again.compatible(c)
    with pytest.raises(ValueError):
        embed.with_idf(idf)


def test_quantiser(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, vec array<double>")
    t = pq.train(df, 2, 4)
    books = pq.codebooks(t)
    codes = pq.encode(df, t)
    got = {r["doc_id"]: r["code"] for r in codes.collect()}
    want = pq.nearest_codes(x, books)
    assert all(got[i] == want[i].tolist() for i in range(60))
    flat = {r["doc_id"]: r["vec"] for r in pq.decode(codes, t).collect()}
    q = df.where("doc_id = 0").withColumnRenamed("doc_id", "query_id")
    for r in pq.adc(codes, pq.lookup(q, t)).collect():
        assert math.isclose(r["l2"], ((x[0] - np.array(flat[r["doc_id"]])) ** 2).sum(), rel_tol=1e-9)
        assert math.isclose(r["ip"], x[0] @ np.array(flat[r["doc_id"]]), abs_tol=1e-9)
    with pytest.raises(ValueError):
        pq.check(10, 3, 4)


def test_quantiser_is_trained_on_all_vectors(spark):
    """A rare cluster that 100,000 other rows come before by their hashes has its centroid."""
    ids = spark.range(100_200).withColumnRenamed("id", "doc_id")
    rare = [r[0] for r in ids.orderBy(F.xxhash64("doc_id", F.lit(0)).desc()).limit(20).collect()]
    x = F.when(F.col("doc_id").isin(rare), 100.0).otherwise(F.col("doc_id") % 7 / 100)
    books = pq.codebooks(pq.train(ids.withColumn("vec", F.array(x, x)), 1, 2))
    assert sorted(round(v, 6) for v in books[0, :, 0])[1] == 100.0


def test_factorisation():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((20, 6))
    m = a @ a.T
    i, j = np.triu_indices(20)
    x, values = pmi.factorise(20, i, j, m[i, j], 6)
    assert np.allclose(x @ x.T, m, atol=1e-6) and (np.diff(values) <= 0).all()


def test_fragments_and_geometry(spark):
    topics = ["volcano lava eruption magma", "cello violin sonata orchestra", "enzyme protein receptor kinase"]
    rows = [(i, f"The {topics[i % 3]} rises here {i}. Every {topics[i % 3]} falls again {i}. Some {topics[i % 3]} stays {i}.") for i in range(9)] + [(9, None), (10, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(1, "volcano lava magma")], "query_id long, text string")
    c = embed.EncoderConfig(sketch_dim=256, output_dim=64, fold=True, features="both", bounded=True)
    stats = lx.build(lx.words(d)).stats
    for b in ("basic", "rich_mmr"):
        got = fragments.build(d, stats, c, b)
        assert {r[0] for r in got.select("doc_id").distinct().collect()} >= set(range(9))
    frags = fragments.build(d, stats, c)
    v = embed.encode(q, c, key="query_id")
    for config in (geometry.GeometryConfig(alpha=0.2), geometry.GeometryConfig(alpha=0.2, use_scale=False, csls_k=2, prefix=16)):
        best = rankers.top(geometry.rerank(rankers.score(d, q), q, d, v, frags, config), 3).collect()
        assert {r["doc_id"] % 3 for r in best} == {0}
    for b in fragments.BUILDERS:
        assert fragments.choose([{"a": 1.0}, {"b": 1.0}, {"c": 1.0}], 2, b)
    assert fragments.choose([{"a": 1.0}, {"a": 1.0}, {"b": 1.0}, {"c": 1.0}], 2) == [0, 2, 3]


def test_diffusion_loses_what_is_isolated():
    w = geometry.adjacency(np.array([[1, 0.9, 0], [0.9, 1, 0], [0, 0, 1]]), 0.5, 2, 8.0)
    out = geometry.diffuse(np.full(3, 1 / 3), w, 1)
    assert np.allclose(out, [1 / 3, 1 / 3, 1 / 6])


MANIFEST = """
# a run
schema = 1
name = "a \\"b\\" # c"
[variant.one]
kind = bm25
k1 = 0.9
"""


def test_manifests():
    m = experiments.parse_manifest(MANIFEST)
    assert m.metadata["name"] == 'a "b" # c'
    assert experiments.resolve(m.variants["one"], experiments.KINDS).k1 == 0.9
    for bad in (MANIFEST + "k1 = 2\n", MANIFEST + "[variant.one]\n", "schema = 2\nname = x\n[variant.a]\nkind = b", MANIFEST + "[other]\n"):
        with pytest.raises(ValueError):
            experiments.parse_manifest(bad)
    with pytest.raises(ValueError):
        experiments.resolve({"kind": "bm25", "odd": "1"}, experiments.KINDS)
    assert experiments.as_int("0x10") == 16 and experiments.as_bool("on") is True


def test_spearman_keeps_rows_whose_values_are_never_computed_alike(spark):
    """Sums in another order differ in their last bits; each run of this table gives other values."""

    def noisy(batches):
        rng = np.random.default_rng()
        for b in batches:
            i = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(i + rng.random(len(i)) / 2), pa.array(-i - rng.random(len(i)) / 2)], names=["x", "y"])

    got = evaluate.spearman(spark.range(60).mapInArrow(noisy, "x double, y double"), "x", "y").first()
    assert got["n"] == 60 and abs(got["rho"] + 1) < 1e-12


def test_policies():
    experiments.check_policy("exploration", "dev", 5)
    experiments.check_policy("frozen", "test", 1, "run 3")
    for args in (("exploration", "test", 1), ("frozen", "test", 2, "x"), ("frozen", "test", 1), ("odd", "dev", 1)):
        with pytest.raises(ValueError):
            experiments.check_policy(*args)
    experiments.check_regime("artifact_free", ["encoder"])
    with pytest.raises(ValueError):
        experiments.check_regime("artifact_free", ["encoder", "bm25"])
