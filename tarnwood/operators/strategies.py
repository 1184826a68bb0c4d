"""Retrieval strategies over the shared scoring join."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.functions import text as T
from tarnwood.session import keep

from . import lexindex as lx
from . import rankers, routing, scan


def lead_field(docs: DataFrame, queries: DataFrame, n: int = 64, body: float = 0.85, extra: float = 0.15) -> DataFrame:
    """Two-field BM25: the whole text and its first n tokens, with the query on both."""
    asked = lx.query_words(queries)
    return rankers.fields(lx.words(docs), lx.lead_field(docs, n), asked, asked, body, extra)


def with_evidence(docs: DataFrame, queries: DataFrame, relations: DataFrame | None = None, boost: float = 0.0, aux_query: bool = True) -> DataFrame:
    """Two-field BM25 where the second field's query is the query's own lead, plus boost * w for ``relations(query_id, doc_id, w)``."""
    asked = lx.query_words(queries)
    lead = queries.select("query_id", T.terms(T.lead_tokens("text")).alias("terms"))
    base = rankers.fields(lx.words(docs), lx.lead_field(docs), asked, lead) if aux_query else rankers.score(docs, queries)
    if relations is None or boost <= 0:
        return base
    known = relations.join(docs.select("doc_id"), "doc_id", "left_semi")
    return rankers.summed(base, known.select("query_id", "doc_id", (F.lit(float(boost)) * F.col("w")).alias("score")))


def scientific_evidence(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, aux, entities): the auxiliary field made of a paper's sections, and its entities."""
    return docs.select(key, T.aux_field("text").alias("aux"), T.entities("text").alias("entities"))


def scientific(docs: DataFrame, queries: DataFrame, body: float = 0.85, extra: float = 0.15) -> DataFrame:
    """Two-field BM25 for papers: the text, and the field made of its sections, which the query's first tokens ask."""
    asked = lx.query_words(queries)
    lead = queries.select("query_id", T.terms(T.lead_tokens("text")).alias("terms"))
    aux = docs.select("doc_id", T.terms(T.aux_field("text")).alias("terms"))
    return rankers.fields(lx.words(docs), aux, asked, lead, body, extra)


def digest(rows: DataFrame, *columns: str) -> DataFrame:
    """One row (rows, digest) that any change of the named columns changes, whatever the order of the rows: the sum of 52 bits of each row's MD5. Doubles count to six places; null is as ''."""

    def shown(c: str):
        kind = rows.schema[c].dataType.simpleString()
        return F.round(F.col(c) * 1e6).cast("long") if kind in ("double", "float") else F.col(c)

    line = F.concat_ws("|", *[F.coalesce(shown(c).cast("string"), F.lit("")) for c in columns])
    part = F.conv(F.substring(F.md5(line), 1, 13), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))


def keyphrase(docs: DataFrame, queries: DataFrame, scale: float = 0.3, least_entropy: float = 0.30, k: int | None = None) -> DataFrame:
    """Where the best ten are torn, the z-score of BM25 plus a share of the query's keyphrases found; elsewhere BM25 as it is.

    Z-scores are over all documents, unmatched ones as 0, by sums alone; rows are given for documents with a match,
    with ``k`` only for those that can be among the k best of a query.
    """
    own = docs.select("doc_id")
    n = own.agg(F.count("*").alias("n"))
    found = rankers.scanned(docs, queries, ("atire",)) if k is not None else None
    scores = rankers.score(docs, queries) if found is None else keep(rankers.leg(found.best(10), "atire"), "best")
    torn = routing.entropy(rankers.top_dense(scores, queries, own, 10)).select("query_id", "entropy")
    sums = scores.groupBy("query_id").agg(F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("s2")) if found is None else found.sums().drop("leg", "n")
    stats = sums.crossJoin(F.broadcast(n))
    stats = stats.select("query_id", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2))).alias("sd"))
    phrases = queries.select("query_id", T.keyphrases("text").alias("terms"))
    sized = phrases.select("query_id", F.size("terms").alias("n_kp"))
    if found is not None:
        stats, torn = keep(stats, "stats"), keep(torn, "torn")
        scores, hits = _boosted(docs, queries, phrases, stats.join(torn, "query_id").join(sized, "query_id"), scale, least_entropy, k)
        return _keyphrase_scores(scores, hits, stats, torn, sized, scale, least_entropy)
    terms = phrases.select("query_id", F.explode("terms").alias("term"))
    index = lx.build(lx.words(docs), terms)
    hits = terms.join(index.postings, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))
    return _keyphrase_scores(scores, hits, stats, torn, sized, scale, least_entropy)


def _boosted(docs: DataFrame, queries: DataFrame, phrases: DataFrame, per: DataFrame, scale: float, least_entropy: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(scores, hits) of the documents that can be among the k best: score / (sd + 1e-12) + lam * scale * hits / n_kp has their order."""
    rates = {}
    for r in per.collect():
        torn = r["entropy"] >= least_entropy and r["n_kp"] > 0
        rates[r["query_id"]] = (1 / (r["sd"] + 1e-12), scale / (1 + math.exp(-(r["entropy"] - 0.48) * 8)) / r["n_kp"]) if torn else (1.0, 0.0)
    own = {r["query_id"]: r["terms"] for r in phrases.collect()}

    def more(got: list, at: dict) -> tuple[dict, dict]:
        word: Counter = Counter((at[r["query_id"]], t) for r in got for t in r["terms"])
        rate = {at[q]: x for q, x in rates.items()}
        hit = {(at[q], t): 1.0 for q, terms in own.items() for t in terms}
        boost = [("word", "atire", {c: w * rate[c[0]][0] for c, w in word.items() if c[0] in rate}), ("word", "hits", {c: rate[c[0]][1] for c in hit if c[0] in rate})]
        return {"word": {t for _, t in hit}}, {"hits": [("word", "hits", hit)], "boost": boost}

    found = rankers.scanned(docs, queries, ("atire",), more=more, within={"hits": "atire", "boost": "atire"}, by=("boost",))
    # some more than k, since the last sum is rounded only below
    wide = keep(found.best(2 * k + 20), "boosted")
    return rankers.leg(wide, "atire"), wide.where("hits is not null").select("query_id", "doc_id", "hits")


def _keyphrase_scores(scores: DataFrame, hits: DataFrame, stats: DataFrame, torn: DataFrame, sized: DataFrame, scale: float, least_entropy: float) -> DataFrame:
    met = scores.join(hits, ["query_id", "doc_id"], "left").join(stats, "query_id").join(torn, "query_id").join(sized, "query_id")
    lam = 1 / (1 + F.exp(-(F.col("entropy") - 0.48) * 8))
    z = (F.col("score") - F.col("mean")) / (F.col("sd") + 1e-12)
    boosted = z + lam * F.lit(scale) * F.coalesce("hits", F.lit(0)) / F.col("n_kp")
    return met.select("query_id", "doc_id", F.when((F.col("entropy") < least_entropy) | (F.col("n_kp") == 0), F.col("score")).otherwise(boosted).alias("score"))


def mine_concepts(rows: DataFrame, min_ttf: int = 5, floor: float = 2.0, most: int = 200_000) -> DataFrame:
    """(term, a, b, pmi, idf, df, ttf): neighbours that occur together far more often than by chance; ``most`` with the highest PMI (equal ones by term)."""
    pairs, single = lx.statistics(rows, bigrams=True), lx.statistics(rows)
    parts = F.split("term", " ")
    named = pairs.where(F.col("ttf") >= min_ttf).withColumns({"a": parts[0], "b": parts[1]})
    one, two = (single.select(F.col("term").alias(x), F.col("ttf").alias(f"ttf_{x}")) for x in "ab")
    n = F.size("terms")
    totals = rows.agg(F.coalesce(F.sum(F.greatest(n - 1, F.lit(0))), F.lit(0)).alias("pairs"), F.coalesce(F.sum(n), F.lit(0)).alias("words"))
    pmi = F.log((F.col("ttf") / F.col("pairs")) / (F.col("ttf_a") / F.col("words") * F.col("ttf_b") / F.col("words")))
    found = named.join(one, "a").join(two, "b").crossJoin(F.broadcast(totals)).withColumn("pmi", pmi).where(F.col("pmi") >= floor)
    return found.orderBy(F.desc(F.round("pmi", 9)), "term").limit(most).select("term", "a", "b", "pmi", "idf", "df", "ttf")


def concept_scores(rows: DataFrame, asked: DataFrame, concepts: DataFrame) -> DataFrame:
    """The sum over a query's distinct concepts of pmi * Atire on bigram counts and bigram lengths."""
    terms = asked.select("query_id", F.explode(F.array_distinct(T.ordered_bigrams(F.col("terms")))).alias("term")).join(concepts.select("term", F.col("pmi").alias("qtf")), "term")
    return rankers.summed(rankers.contributions(terms, lx.build(lx.ordered(rows), terms), rankers.expression("atire")))


def with_concepts(docs: DataFrame, queries: DataFrame, concepts: DataFrame, w: float = 0.5, k: int | None = None) -> DataFrame:
    """BM25 + w * concept scores; with ``k`` only of documents that can be among the k best of a query."""
    if k is not None and w:
        own = lx.query_words(queries).select(F.explode(F.array_distinct(T.ordered_bigrams(F.col("terms")))).alias("term")).distinct()
        known = concepts.join(own, "term", "left_semi").select("term", "pmi").limit(scan.MOST_WEIGHTS + 1).collect()
        pmi = {r["term"]: r["pmi"] for r in known}

        def more(got: list, at: dict) -> tuple[dict, dict]:
            base: Counter = Counter((at[r["query_id"]], t) for r in got for t in r["terms"])
            extra: Counter = Counter()
            for r in got:
                for x in {f"{a} {b}" for a, b in zip(r["terms"], r["terms"][1:])} & pmi.keys():
                    extra[at[r["query_id"]], x] += w * pmi[x]
            return {"bigram": set(pmi)} if pmi else {}, {"both": [("word", "atire", dict(base))] + ([("bigram", "atire", dict(extra))] if pmi else [])}

        found = rankers.scanned(docs, queries, (), more=more) if len(known) <= scan.MOST_WEIGHTS else None
        if found is not None:
            return rankers.leg(found.best(k), "both")
    base = rankers.score(docs, queries)
    return base if not w else rankers.summed(base, rankers.weighted(concept_scores(lx.words(docs), lx.query_words(queries), concepts), w))


def doc_concepts(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """(doc_id, term, pmi, n): the concepts of each document with their occurrences."""
    own = lx.ordered(rows).select("doc_id", F.explode("terms").alias("term"))
    return own.join(concepts.select("term", "pmi"), "term").groupBy("doc_id", "term", "pmi").agg(F.count("*").alias("n"))


STOPWORDS = tuple("a an and are as at be by for from in into is it of on or that the their this to was were with".split())


def signatures(rows: DataFrame, stats: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, term, weight): the heaviest terms of each text that are no stopwords and have three letters; weight = max(0.25, idf)."""
    own = rows.select("doc_id", F.explode(F.array_distinct("terms")).alias("term")).where((F.length("term") >= 3) & ~F.col("term").isin(*STOPWORDS))
    met = own.join(stats.select("term", "idf"), "term", "left").select("doc_id", "term", F.greatest(F.lit(0.25), F.coalesce("idf", F.lit(0.0))).alias("weight"))
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("weight", 9)), "term")
    return met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")


def signature_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, overlap) of signatures that share a term: the sum of lesser weights over the lesser weight sum."""
    sums = lambda s, x: s.groupBy("doc_id").agg(F.sum("weight").alias(f"sum_{x}")).withColumnRenamed("doc_id", x)
    met = left.select(F.col("doc_id").alias("a"), "term", F.col("weight").alias("wa")).join(right.select(F.col("doc_id").alias("b"), "term", F.col("weight").alias("wb")), "term")
    inter = met.groupBy("a", "b").agg(F.sum(F.least("wa", "wb")).alias("i"))
    out = inter.join(sums(left, "a"), "a").join(sums(right, "b"), "b")
    return out.select("a", "b", (F.col("i") / F.greatest(F.lit(1e-6), F.least("sum_a", "sum_b"))).alias("overlap"))
