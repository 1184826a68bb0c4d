"""The queries of the retrieval operators, with their SQL.

Each takes (spark, sf_dir), reads whole tables, and treats every row of
``benchmark`` as a query over all ``documents``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwood.functions import text as T
from tarnwood.functions import vectors as V
from tarnwood.operators import bpe, dictmatch, embed, evaluate, experiments, feedback, fragments, fusion, geometry, hashed, minhash, pmi, pq, rankers, recipes, routing, scan, strategies, textrank, topology
from tarnwood.operators import lexindex as lx

from tarnwood.session import keep

from . import given, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


#: What was written for the tables of a folder, by session, folder and the state of its files.
_KEPT: dict[tuple, DataFrame] = {}


class Tables:
    """The tables as the operators want them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def state(self, name: str) -> tuple:
        """The number of files of a table, their bytes and the time of the last change."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}.parquet")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        sizes = fs.getContentSummary(at)
        return sizes.getFileCount(), sizes.getLength(), fs.getFileStatus(at).getModificationTime()

    def kept(self, name: str, make: Callable[[], DataFrame], source: str = "documents") -> DataFrame:
        """What ``make`` gives, written once a session for as long as the table it comes from stays as it is."""
        key = (self.spark.sparkContext.applicationId, self.dir, name, self.state(source))
        if key not in _KEPT:
            _KEPT[key] = keep(make(), name)
        return _KEPT[key]

    @property
    def plain(self) -> DataFrame:
        return self.read("documents").select("doc_id", "text")

    @property
    def docs(self) -> DataFrame:
        """The documents with their words: texts are split once, and each query reads the column it needs."""
        return self.kept("documents", lambda: lx.tokenised(self.plain))

    @property
    def asks(self) -> DataFrame:
        return self.read("benchmark").select(F.col("item_id").alias("query_id"), "text")

    @property
    def words(self) -> DataFrame:
        return lx.words(self.docs)

    @property
    def asked(self) -> DataFrame:
        return lx.query_words(self.asks)

    @property
    def qrels(self) -> DataFrame:
        """Documents that contain an item's text word for word, all items looked for at once."""
        asks = self.asks.where("text <> ''")
        patterns = asks.groupBy("text").agg(F.min("query_id").alias("pattern_id")).withColumnRenamed("text", "pattern")
        hits = dictmatch.match_docs(self.plain, patterns, fold=False, whole_word=False, longest=False).select("doc_id", "pattern_id").distinct()
        named = asks.join(patterns, F.col("text") == F.col("pattern")).select("query_id", "pattern_id")
        return hits.join(named, "pattern_id").select("query_id", "doc_id", F.lit(1).alias("relevance"))

    @property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))

    @property
    def units(self) -> DataFrame:
        return self.vectors.where(V.norm(F.col("vec")) > 0).withColumn("vec", V.l2_normalize(F.col("vec")))

    @property
    def label_pairs(self) -> DataFrame:
        """Cosines of all pairs of vectors within a label."""
        u = self.units
        return u.alias("a").join(u.alias("b"), F.expr("a.label = b.label and a.vec_id < b.vec_id")).select(F.col("a.label").alias("label"), F.col("a.vec_id").alias("i"), F.col("b.vec_id").alias("j"), V.dot(F.col("a.vec"), F.col("b.vec")).alias("sim"))

    def score(self, variant: str, p: rankers.Params = rankers.DEFAULT) -> DataFrame:
        return rankers.score(self.docs, self.asks, variant, p)

    def best(self, variant: str, k: int) -> DataFrame:
        """The scores of a variant, as far as they can be among the k best of a query."""
        return rankers.best(self.docs, self.asks, variant, k)

    @property
    def legs(self) -> DataFrame:
        """The scores of three variants: in each, all that can be among the 50 best of a query, and what the others say of them."""
        found = rankers.scanned(self.docs, self.asks, tuple(WEIGHTS))
        return rankers.score_many(self.docs, self.asks, tuple(WEIGHTS)) if found is None else fusion.long(keep(found.best(50), "legs"), list(WEIGHTS))

    @property
    def pooled(self) -> DataFrame:
        legs = self.legs
        return fusion.over_pool(legs, fusion.pool_union(legs, 50), list(WEIGHTS))

    @property
    def term_stats(self) -> DataFrame:
        return lx.statistics(self.words)

    @property
    def concepts(self) -> DataFrame:
        return strategies.mine_concepts(self.words)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def best(scores: DataFrame, k: int = 10) -> DataFrame:
    return rounded(rankers.top(scores, k), "score")


# text


@query
def word_tokens(s, d):
    return Tables(s, d).plain.select("doc_id", F.array_join(T.words("text"), " ").alias("tokens"))


def _grams(s, d, make) -> DataFrame:
    plain = Tables(s, d).plain
    if scan.unique_ids(plain):
        return hashed.gram_counts(plain, make is T.bounded_ngrams)
    flat = plain.select("doc_id", F.explode(make("text")).alias("gram"))
    return flat.groupBy("gram", "doc_id").agg(F.count("*").alias("n")).groupBy("gram").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))


@query
def byte_ngrams(s, d):
    return _grams(s, d, T.byte_ngrams)


@query
def word_bounded_ngrams(s, d):
    return _grams(s, d, T.bounded_ngrams)


@query
def lead_tokens(s, d):
    return Tables(s, d).plain.select("doc_id", T.lead_tokens("text").alias("lead"))


@query
def keyphrases(s, d):
    return Tables(s, d).plain.select("doc_id", F.array_join(T.keyphrases("text"), " ").alias("phrases"))


@query
def sentence_split(s, d):
    return Tables(s, d).plain.select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))


@query
def sentence_tokens(s, d):
    return sentence_split(s, d).select("doc_id", "pos", F.array_join(T.sentence_tokens("sentence"), " ").alias("tokens"))


@query
def ascii_fold(s, d):
    return Tables(s, d).plain.select("doc_id", F.md5(T.ascii_fold("text")).alias("folded"))


@query
def entities(s, d):
    return Tables(s, d).plain.select("doc_id", F.array_join(T.entities("text"), " ").alias("entities"))


@query
def aux_fields(s, d):
    return Tables(s, d).plain.select("doc_id", T.aux_field("text").alias("aux"))


# index


@query
def term_stats(s, d):
    return rounded(Tables(s, d).term_stats, "idf")


@query
def corpus_stats(s, d):
    return rounded(lx.corpus_stats(Tables(s, d).words.select(F.size("terms").cast("long").alias("dl"))), "avg_dl")


@query
def bigram_ordered(s, d):
    return lx.build(lx.ordered(Tables(s, d).words)).stats.drop("idf")


@query
def bigram_unordered(s, d):
    words = Tables(s, d).words
    if scan.unique_ids(words):
        return hashed.unordered_pairs(words)
    return lx.build(lx.unordered(words)).postings.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.sum("tf").alias("dl"))


@query
def gram_stats_pruned(s, d):
    return rounded(lx.build(lx.grams(Tables(s, d).words), max_df_ratio=0.5).stats, "idf")


# ranking


def _ranked(name: str, variant: str) -> None:
    def run(s, d):
        return best(Tables(s, d).best(variant, 10))

    run.__name__ = name
    query(run)


for _name, _variant in {
    "bm25_atire": "atire",
    "bm25_plus": "plus",
    "bm25_l": "bm25l",
    "bm25_ltd": "ltd",
    "dlh13": "dlh13",
    "pl2": "pl2",
    "dph": "dph",
    "dcm": "dcm",
    "bm25_sab": "sab",
    "sdm": "sdm",
    "wsdm": "wsdm",
    "layered": "layered",
    "layered_w": "layered_w",
}.items():
    _ranked(_name, _variant)


@query
def bm25f_lead(s, d):
    t = Tables(s, d)
    return best(strategies.lead_field(t.docs, t.asks))


@query
def recipe_by_avgdl(s, d):
    return rounded(rankers.recipe_by_length(lx.corpus_stats(Tables(s, d).words.select(F.size("terms").cast("long").alias("dl")))), "avg_dl")


# feedback and fusion


@query
def rm1_terms(s, d):
    t = Tables(s, d)
    return rounded(feedback.strongest(feedback.relevance_model(t.words, feedback.feedback_docs(t.best("atire", 10)))), "weight")


@query
def rm3(s, d):
    t = Tables(s, d)
    return best(feedback.rm3(t.docs, t.asks, best=10))


@query
def rm3_explicit(s, d):
    t = Tables(s, d)
    return best(feedback.rm3(t.docs, t.asks, feedback=t.qrels.select("query_id", "doc_id", F.lit(1.0).alias("w")), best=10))


@query
def rrf_variants(s, d):
    t = Tables(s, d)
    found = rankers.scanned(t.docs, t.asks, tuple(WEIGHTS))
    fused = None if found is None else fusion.rrf_best(found, 10)
    return best(fusion.rrf(rankers.score_many(t.docs, t.asks, tuple(WEIGHTS))) if fused is None else fused)


WEIGHTS = {"atire": 0.5, "plus": 0.3, "bm25l": 0.2}


@query
def convex_z(s, d):
    return best(fusion.convex_z(Tables(s, d).pooled, WEIGHTS))


@query
def minmax_fusion(s, d):
    return best(fusion.min_max(Tables(s, d).pooled, WEIGHTS))


@query
def combsum(s, d):
    return best(fusion.comb_sum(Tables(s, d).pooled))


@query
def union_pool(s, d):
    return fusion.pool_union(Tables(s, d).legs, 50)


# routing and strategies


@query
def query_features(s, d):
    t = Tables(s, d)
    df = routing.features(t.docs, t.asks)
    return rounded(df, *[c for c in df.columns if c not in ("query_id", "n_terms")])


@query
def query_features_post(s, d):
    t = Tables(s, d)
    found = rankers.scanned(t.docs, t.asks, ("atire", "plus"))
    if found is None:
        first, second, sums = t.score("atire"), t.score("plus"), None
    else:
        both = keep(found.best(50), "legs")
        first, second, sums = rankers.leg(both, "atire"), rankers.leg(both, "plus"), found.sums().where("leg = 'atire'")
    df = routing.pool_features(first, t.asks, t.docs, routing.features(t.docs, t.asks), 50, second, sums)
    return rounded(df, *[c for c in df.columns if c != "query_id"])


@query
def route(s, d):
    t = Tables(s, d)
    return routing.choose(routing.features(t.docs, t.asks)).select("query_id", "recipe")


@query
def route_quality(s, d):
    t = Tables(s, d)
    return routing.choose_quality(routing.features(t.docs, t.asks)).select("query_id", "quality_recipe")


def _best_ten(t: Tables) -> DataFrame:
    return rankers.top_dense(t.best("atire", 10), t.asks, t.docs, 10)


@query
def entropy_route(s, d):
    return routing.route_by_entropy(routing.entropy(_best_ten(Tables(s, d))), ("bm25", "lead", "keyphrase"))


@query
def assess_quality(s, d):
    return rounded(routing.assess_quality(_best_ten(Tables(s, d))), "quality")


@query
def keyphrase_boost(s, d):
    t = Tables(s, d)
    return best(strategies.keyphrase(t.docs, t.asks, k=10))


@query
def relation_boost(s, d):
    t = Tables(s, d)
    return best(strategies.with_evidence(t.docs, t.asks, t.qrels.select("query_id", "doc_id", F.lit(1.0).alias("w")), 2.0))


# mining


@query
def concepts(s, d):
    return rounded(Tables(s, d).concepts, "pmi", "idf")


@query
def concept_score(s, d):
    t = Tables(s, d)
    return best(strategies.concept_scores(t.words, t.asked, t.concepts))


@query
def bm25_concepts(s, d):
    t = Tables(s, d)
    return best(strategies.with_concepts(t.docs, t.asks, t.concepts, k=10))


@query
def doc_concepts(s, d):
    t = Tables(s, d)
    return rounded(strategies.doc_concepts(t.words, t.concepts), "pmi")


@query
def pmi_vocab(s, d):
    return pmi.vocabulary(Tables(s, d).words)


@query
def pmi_cooc(s, d):
    t = Tables(s, d)
    return pmi.cooccurrence(t.words, pmi.vocabulary(t.words))


@query
def ppmi(s, d):
    return rounded(pmi.ppmi(pmi_cooc(s, d)), "w")


@query
def sparse_signature(s, d):
    t = Tables(s, d)
    return rounded(strategies.signatures(t.words, t.term_stats), "weight")


@query
def signature_overlap(s, d):
    t = Tables(s, d)
    stats = t.term_stats
    asked = strategies.signatures(t.asked.withColumnRenamed("query_id", "doc_id"), stats)
    return rounded(strategies.signature_overlap(asked, strategies.signatures(t.words, stats)), "overlap")


@query
def jaccard_terms(s, d):
    """The term overlap of queries and the documents that share a term with them."""
    t = Tables(s, d)
    size = lambda df, k, n: df.select(k, F.size(F.array_distinct("terms")).alias(n))
    terms = t.asked.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    common = terms.join(lx.build(t.words, terms).postings, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("c"))
    met = common.join(size(t.asked, "query_id", "a"), "query_id").join(size(t.words, "doc_id", "b"), "doc_id")
    return met.select("query_id", "doc_id", F.round(F.col("c") / (F.col("a") + F.col("b") - F.col("c")), 6).alias("jaccard"))


# vectors and topology


@query
def largest_gap(s, d):
    return rounded(topology.largest_gap(Tables(s, d).label_pairs, "label"), "scale")


@query
def max_persistence_scale(s, d):
    return rounded(topology.strongest_of(Tables(s, d).units, "label", "vec_id"), "scale")


@query
def phss_deaths(s, d):
    return topology.deaths(Tables(s, d).label_pairs, "label")


@query
def elbow_scale(s, d):
    return topology.elbow(phss_deaths(s, d), "label")


@query
def cosine_topk(s, d):
    u = Tables(s, d).units
    near = evaluate.exact_dense(u.select(F.col("vec_id").alias("query_id"), "vec"), u.select(F.col("vec_id").alias("doc_id"), "vec"), 11).where("query_id <> doc_id")
    return best(near.drop("rank"))


@query
def l2_normalize(s, d):
    return rounded(Tables(s, d).units.select("vec_id", F.posexplode("vec").alias("dim", "x")), "x")


@query
def prefix_normalize(s, d):
    return rounded(Tables(s, d).vectors.select("vec_id", F.posexplode(V.prefix_normalize(F.col("vec"), 16)).alias("dim", "x")), "x")


@query
def matryoshka_weights(s, d):
    return rounded(embed.nested_weights(Tables(s, d).vectors), "weight")


def _fixed_books(s: SparkSession) -> DataFrame:
    return pq.table_of(s, np.array([[[math.sin(i * 131 + k * 17 + j * 7) for j in range(8)] for k in range(16)] for i in range(8)]))


@query
def pq_encode_fixed(s, d):
    return pq.encode(Tables(s, d).vectors, _fixed_books(s), key="vec_id").select("vec_id", F.array_join("code", " ").alias("code"))


@query
def adc_fixed(s, d):
    """Every vector whose id is divisible by 50 asks; all codes answer."""
    v = Tables(s, d).vectors
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    return rounded(pq.adc(pq.encode(v, _fixed_books(s), key="vec_id"), pq.lookup(asked, _fixed_books(s)), key="vec_id"), "l2", "ip")


@query
def pq_train(s, d):
    return pq.train(Tables(s, d).vectors, 8, 16, key="vec_id")


@query
def pq_decode(s, d):
    v = Tables(s, d).vectors
    vec = pq.decode(pq.encode(v, _fixed_books(s), key="vec_id"), _fixed_books(s), key="vec_id")
    return rounded(vec.select("vec_id", F.posexplode("vec").alias("dim", "x")), "x")


@query
def cluster_separation(s, d):
    return rounded(evaluate.cluster_separation(Tables(s, d).vectors), "intra", "inter")


# evaluation


def _all_scores(t: Tables) -> DataFrame:
    return rankers.top_dense(t.best("atire", 100), t.asks, t.docs, 100).drop("rank")


@query
def eval_trec(s, d):
    t = Tables(s, d)
    return rounded(evaluate.metrics(_all_scores(t), t.qrels), "ndcg10", "p10", "r10", "r100", "mrr10")


@query
def eval_capped(s, d):
    t = Tables(s, d)
    return rounded(evaluate.metrics(_all_scores(t), t.qrels, capped=True), "ndcg10", "p10", "r10", "r100", "mrr10")


@query
def candidate_recall(s, d):
    t = Tables(s, d)
    return rounded(evaluate.candidate_recall(rankers.top_dense(t.best("atire", 50), t.asks, t.docs, 50), t.qrels), "recall")


@query
def union_recall(s, d):
    t = Tables(s, d)
    return rounded(evaluate.union_recall(t.legs, t.qrels, 50), "recall")


@query
def spearman(s, d):
    t = Tables(s, d)
    return rounded(evaluate.spearman(routing.features(t.docs, t.asks), "scq", "clarity"), "rho")


@query
def latency_summary(s, d):
    return rounded(evaluate.latency_summary(Tables(s, d).read("conversations").where("text is not null").select("role", F.octet_length("text").alias("n")), "n", "role"), "mean")


# sketches and encoders


@query
def splitmix_sketch(s, d):
    return hashed.sketch(Tables(s, d).plain, 4096)


@query
def idf_buckets(s, d):
    return hashed.bucket_weights(Tables(s, d).plain, 65_536)


@query
def minhash_min_per_bin(s, d):
    return hashed.bin_minima(Tables(s, d).plain, 256)


@query
def minhash_signatures(s, d):
    return minhash.signatures(Tables(s, d).plain)


@query
def minhash_estimates(s, d):
    t = Tables(s, d)
    a = minhash.signatures(t.asks, key="query_id").withColumnRenamed("signature", "a")
    b = minhash.signatures(t.plain).withColumnRenamed("signature", "b")
    return t.qrels.join(a, "query_id").join(b, "doc_id").select("query_id", "doc_id", minhash.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query
def encode_v1(s, d):
    return embed.encode(Tables(s, d).plain)


@query
def encode_compact(s, d):
    return embed.encode(Tables(s, d).plain, embed.COMPACT)


@query
def encode_hashed_idf(s, d):
    docs = Tables(s, d).plain
    idf = embed.learn_idf(docs)
    return embed.encode(docs, embed.with_idf(idf), idf)


def _projected(mode: str) -> None:
    def run(s, d):
        return embed.encode(Tables(s, d).plain, embed.EncoderConfig(projection=mode, sketch_dim=1024, output_dim=128))

    run.__name__ = f"project_{mode}"
    query(run)


for _mode in ("gaussian", "very_sparse", "sparse_jl", "fwht"):
    _projected(_mode)


@query
def xxhash_sketch(s, d):
    return embed.builtin_sketch(Tables(s, d).plain)


@query
def pmi_vectors(s, d):
    return pmi.vectors(Tables(s, d).words, rank=64)


@query
def pmi_doc_vectors(s, d):
    w = Tables(s, d).words
    return pmi.doc_vectors(w, pmi.vectors(w, rank=32))


@query
def pmi_tempered(s, d):
    return pmi.temper(pmi.vectors(Tables(s, d).words, rank=32))


@query
def bpe_learn(s, d):
    return bpe.learn(Tables(s, d).plain, 400)


@query
def bpe_apply(s, d):
    docs = Tables(s, d).plain
    pieces = bpe.subwords(docs, bpe.learn(docs, 400))
    return pieces.groupBy("doc_id").agg(F.sum(F.size("pieces")).alias("n_pieces"), F.count("*").alias("n_words"))


@query
def text_rank(s, d):
    return textrank.rank_docs(Tables(s, d).plain)


@query
def textrank_lead(s, d):
    return textrank.lead_agreement(Tables(s, d).plain)


@query
def dict_match(s, d):
    t = Tables(s, d)
    return dictmatch.match_docs(t.plain, t.asks.select(F.col("query_id").alias("pattern_id"), F.col("text").alias("pattern"))).drop("type_id")


@query
def dict_match_words(s, d):
    t = Tables(s, d)
    return dictmatch.word_dictionary(t.docs, t.asks.select(F.col("query_id").alias("pattern_id"), F.col("text").alias("pattern")))


# fragments and geometry

_SMALL = embed.EncoderConfig(features="both", bounded=True, fold=True, sketch_dim=1024, output_dim=128, projection="fwht")


def _built(name: str) -> None:
    def run(s, d):
        t = Tables(s, d)
        return fragments.build(t.docs, t.term_stats, _SMALL, name)

    run.__name__ = f"fragments_{name}"
    query(run)


for _builder in fragments.BUILDERS:
    _built(_builder)


def _reranked(name: str, config: geometry.GeometryConfig) -> None:
    def run(s, d):
        t = Tables(s, d)
        found = rankers.scanned(t.docs, t.asks, ("atire",))
        scores = t.score("atire") if found is None else keep(rankers.leg(found.best(config.pool), "atire"), "scores")
        pairs = None if found is None else lambda pool: rankers.leg(found.pairs(pool), "atire")
        frags = lambda ids: fragments.build(t.docs.join(ids, "doc_id", "left_semi"), t.term_stats, _SMALL)
        vectors = embed.encode(t.asks, _SMALL, key="query_id")
        dense = embed.encode(t.plain, _SMALL) if config.dense_pool else None
        return best(geometry.rerank(scores, t.asks, t.docs, vectors, frags, config, dense, score_pairs=pairs))

    run.__name__ = f"geometry_{name}"
    query(run)


for _name, _config in {
    "default": geometry.GeometryConfig(),
    "csls": geometry.GeometryConfig(csls_k=8),
    "knn": geometry.GeometryConfig(use_scale=False),
    "adaptive": geometry.GeometryConfig(adaptive=True),
    "max_sim": geometry.GeometryConfig(outer="max"),
    "soft_max": geometry.GeometryConfig(outer="soft_max"),
    "dense_pool": geometry.GeometryConfig(dense_pool=20),
}.items():
    _reranked(_name, _config)


@query
def doc_topology(s, d):
    t = Tables(s, d)
    return fragments.build(t.docs, t.term_stats, _SMALL, "rich", shape=8)


@query
def fusion_six_leg(s, d):
    t = Tables(s, d)
    return best(experiments.six_leg_fusion(t.docs, t.asks, _SMALL))


@query
def coordinate_calibrated(s, d):
    t = Tables(s, d)
    return best(experiments.coordinate_search(embed.encode(t.asks, _SMALL, key="query_id"), embed.encode(t.plain, _SMALL), prefix=32, mode="blend"))


@query
def family_atlas(s, d):
    t = Tables(s, d)
    return best(experiments.family_atlas(t.docs, t.asks))


# composition


@query
def scientific(s, d):
    t = Tables(s, d)
    return best(strategies.scientific(t.docs, t.asks))


@query
def concept_digest(s, d):
    return strategies.digest(Tables(s, d).concepts, "term", "pmi", "idf", "df", "ttf")


@query
def fixture_digest(s, d):
    t = Tables(s, d)
    docs = strategies.digest(t.plain, "doc_id", "text").withColumn("part", F.lit("documents"))
    return docs.unionByName(strategies.digest(t.asks, "query_id", "text").withColumn("part", F.lit("queries")))


@query
def coordinate_digest(s, d):
    """What was learned from the vectors, as weights by coordinate."""
    return strategies.digest(embed.nested_weights(Tables(s, d).vectors), "dim", "weight")


@query
def encode_subword(s, d):
    """The count sketch of characters, words and subwords."""
    docs = Tables(s, d).plain
    merges = tuple((bytes(r["left"]), bytes(r["right"])) for r in bpe.learn(docs, 400).orderBy("rank").collect())
    return embed.sketch_table(docs, embed.EncoderConfig(features="all", merges=merges, bounded=True, fold=True, projection="none"))


@query
def recipe_rows(s, d):
    t = Tables(s, d)
    table = keep(pmi.vectors(t.words, rank=32), "table")
    dense = evaluate.exact_dense(embed.encode(t.asks, _SMALL, key="query_id"), embed.encode(t.plain, _SMALL), 100).drop("rank")
    rows = recipes.recipes(t.docs, t.asks, _SMALL, table=table, qrels=t.qrels, dense=dense)
    return rounded(recipes.recipe_rows(rows, t.qrels), "ndcg10", "p10", "r10", "r100", "mrr10")


@query
def reranker_workspace(s, d):
    t = Tables(s, d)
    own = recipes.Workspace(t.docs, t.asks, recipes.RerankerConfig(builder="rich", storage="bf16", config=_SMALL))
    return best(own.run(replace(own.config, geometry=geometry.GeometryConfig(pool=50))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | given.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.statements().items() if k in QUERIES} | given.statements()


__all__ = ["Tables", "oracle_sql", "queries"]
