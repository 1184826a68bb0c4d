"""Ranking functions: one scoring join, into which each variant plugs one expression.

The expressions read tf, dl, df, ttf, idf and the corpus's n, total and avg_dl.
Every function takes all queries at once and returns (query_id, doc_id, score)
for documents with a matching term; ``top`` ranks them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.functions import text as T
from tarnwood.session import keep

from . import lexindex as lx
from . import pairs, scan
from .lexindex import LexIndex


@dataclass(frozen=True)
class Params:
    k1: float = 1.2
    b: float = 0.75
    delta: float = 1.0
    gamma: float = 5.0
    ltd_alpha: float = 0.5
    pl2_c: float = 1.0
    dcm_alpha: float = 0.0
    gram_min: int = 3
    gram_max: int = 4
    gram_prune: float = 0.5
    window: int = 8
    unigram: float = 0.85
    ordered: float = 0.10
    unordered: float = 0.05
    beta: float = 1.0

    def __post_init__(self):
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must not be negative, and b must be in [0, 1]")


DEFAULT = Params()


def expression(variant: str, p: Params = DEFAULT) -> str:
    """The contribution of one term to one document, as SQL."""
    ratio = "(dl / avg_dl)"
    norm = f"({1 - p.b}D + {p.b}D * {{}})"
    sat = f"(tf * {p.k1 + 1}D / (tf + {p.k1}D * {norm}))"
    two_pi = "6.283185307179586D"
    info = "tf * log2(tf * avg_dl / dl * n / ttf)"
    spread = f"0.5D * log2({two_pi} * tf * (1D - tf / dl))"
    lengths = f"(tf / {norm.format(ratio)})"
    tfn = f"(tf * log2(1D + {p.pl2_c}D * avg_dl / dl))"
    alpha = f"{p.dcm_alpha}D" if p.dcm_alpha > 0 else "avg_dl"
    return {
        "atire": f"idf * {sat.format(ratio)}",
        "ltd": f"idf * {sat.format(f'power({ratio}, {p.ltd_alpha}D)')}",
        "plus": f"idf * ({sat.format(ratio)} + {p.delta}D)",
        "bm25l": f"idf * {p.k1 + 1}D * ({lengths} + {p.delta}D) / ({p.k1 + p.delta}D + {lengths})",
        "dlh13": f"CASE WHEN tf < dl THEN ({info} + {spread}) / (tf + 0.5D) ELSE 0D END",
        "dph": f"CASE WHEN tf < dl THEN power(1D - tf / dl, 2) / (tf + 1D) * ({info} + {spread}) ELSE 0D END",
        "pl2": f"({tfn} * log2({tfn} * n / ttf) + (ttf / n - {tfn}) * 1.4426950408889634D + 0.5D * log2({two_pi} * {tfn})) / ({tfn} + 1D)",
        "dcm": f"log1p(tf * total / ({alpha} * ttf))",
    }[variant]


def contributions(terms: DataFrame, index: LexIndex, expr: str, corpus: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): each query's terms (with weight ``qtf``) met with the postings."""
    met = terms.join(index.stats, "term").join(index.postings, "term").crossJoin(F.broadcast(index.corpus if corpus is None else corpus))
    return met.select("query_id", "doc_id", (F.col("qtf") * F.expr(expr)).alias("score"))


def summed(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def weighted(part: DataFrame, w: float) -> DataFrame:
    return part.withColumn("score", F.col("score") * F.lit(float(w)))


def top(scores: DataFrame, k: int, places: int = 8) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best of each query; equal scores, to ``places``, rank by doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", places)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def dense(scores: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """The scores with 0 for every other document, as rankings that admit unmatched documents need."""
    every = queries.select("query_id").crossJoin(docs.select("doc_id"))
    return every.join(scores, ["query_id", "doc_id"], "left").fillna(0.0, ["score"])


def top_dense(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``top`` of ``dense`` for scores that are never negative, without the cross product: of the unmatched documents only those among the k least ids can enter."""
    least = docs.select("doc_id").orderBy("doc_id").limit(k)
    filler = queries.select("query_id").crossJoin(F.broadcast(least)).join(scores, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top(scores.unionByName(filler), k)


def score(docs: DataFrame, queries: DataFrame, variant: str = "atire", p: Params = DEFAULT) -> DataFrame:
    """(query_id, doc_id, score) of ``docs(doc_id, text)`` for ``queries(query_id, text)`` under one variant.

    Variants: atire, plus, bm25l, ltd, dlh13, pl2, dph, dcm, sab, sdm, wsdm, layered, layered_w.
    """
    rows, asked = lx.words(docs), lx.query_words(queries)
    if variant == "sab":
        return subword_backoff(rows, asked, p)
    if variant in ("sdm", "layered"):
        return dependence(rows, asked, p)
    if variant in ("wsdm", "layered_w"):
        return dependence(rows, asked, p, weighted_pairs=True)
    terms = lx.query_terms(asked)
    return summed(contributions(terms, lx.build(rows, terms), expression(variant, p)))


def score_many(docs: DataFrame, queries: DataFrame, variants: tuple[str, ...], p: Params = DEFAULT) -> DataFrame:
    """(leg, query_id, doc_id, score) of several one-term variants by one scoring join, which sums all their expressions."""
    terms = lx.query_terms(lx.query_words(queries))
    index = lx.build(lx.words(docs), terms)
    met = terms.join(index.stats, "term").join(index.postings, "term").crossJoin(F.broadcast(index.corpus))
    sums = met.groupBy("query_id", "doc_id").agg(*[F.sum(F.col("qtf") * F.expr(expression(v, p))).alias(v) for v in variants])
    return sums.unpivot(["query_id", "doc_id"], list(variants), "leg", "score").select("leg", "query_id", "doc_id", "score")


def scanned(docs: DataFrame, queries: DataFrame, variants: tuple[str, ...], p: Params = DEFAULT, more: Callable | None = None, terms: dict[str, DataFrame] | None = None, terms_variant: str = "atire", within: dict[str, str] | None = None, by: tuple[str, ...] = ()) -> scan.Scan | None:
    """The variants as legs that are scored where the documents are, or None where only the joins can: ids that repeat, or a query set too large to share.

    ``more(query words, their numbers)`` gives the keys that further legs need
    by kind, and these legs (name: parts of (source, variant, weights));
    ``terms`` adds legs of weighted terms, by name (query_id, term, qtf).
    ``within`` and ``by`` are those of the scan.
    """
    rows, asked = lx.words(docs), lx.query_words(queries)
    got = asked.limit(scan.MOST_QUERIES + 1).collect()
    given = {name: df.where("qtf > 0").select("query_id", "term", "qtf").limit(scan.MOST_WEIGHTS + 1).collect() for name, df in (terms or {}).items()}
    if len(got) > scan.MOST_QUERIES or sum(len(r["terms"]) for r in got) + sum(map(len, given.values())) > scan.MOST_WEIGHTS:
        return None
    if any(r["query_id"] is None for r in got) or not scan.unique_ids(rows):
        return None
    ids = list(dict.fromkeys(r["query_id"] for r in got))
    at = {q: i for i, q in enumerate(ids)}

    def weights(make) -> dict:
        return dict(Counter((at[r["query_id"]], k) for r in got for k in make(r["terms"])))

    word = weights(lambda t: t)
    keys = {"word": {k for _, k in word} | {r["term"] for own in given.values() for r in own}}
    pieces = {t: scan.grams(t, p.gram_min, p.gram_max) for _, t in word} if "sab" in variants else {}
    keys["gram"] = {x for own in pieces.values() for x in own}
    near, loose = {}, {}
    if {"sdm", "layered", "wsdm", "layered_w"} & set(variants):
        near = weights(lambda t: [f"{a} {b}" for a, b in zip(t, t[1:])])
        loose = weights(lambda t: [f"{min(a, b)} {max(a, b)}" for a, b in zip(t, t[1:]) if a != b])
    keys["near"], keys["loose"] = {k for _, k in near}, {k for _, k in loose}
    extra = more(got, at) if more else ({}, {})
    for kind, own in extra[0].items():
        keys[kind] = keys.get(kind, set()) | own
    sources = {kind: scan.Source(kind, list(own), p.window, p.gram_min, p.gram_max, p.gram_prune if kind == "gram" else 0.0) for kind, own in keys.items() if own or kind == "word"}
    scan.count(rows, sources)
    legs = {v: _parts(v, p, sources, word, pieces, near, loose) for v in variants} | extra[1]
    for name, own in given.items():
        w: Counter = Counter()
        for r in own:
            if r["query_id"] in at:
                w[at[r["query_id"]], r["term"]] += r["qtf"]
        legs[name] = [("word", terms_variant, dict(w))]
    return scan.Scan(rows, ids, queries.schema["query_id"].dataType.simpleString(), sources, legs, p, within, by)


def _parts(variant: str, p: Params, sources: dict, word: dict, pieces: dict, near: dict, loose: dict) -> list:
    """The parts of a leg, as the joins below have them."""
    if variant == "sab":
        s = sources["word"]
        df = {t: int(s.stats["df"][s.at[t]]) for _, t in word}
        share = {t: d / (d + p.gamma) if d else 0.0 for t, d in df.items()}
        own: Counter = Counter()
        for (q, t), w in word.items():
            if share[t] < 1:
                for x in dict.fromkeys(pieces[t]):
                    own[q, x] += w * (1 - share[t])
        parts = [("word", "plus", {(q, t): w * share[t] for (q, t), w in word.items() if w * share[t] > 0})]
        return parts + ([("gram", "plus", dict(own))] if own else [])
    if variant not in ("sdm", "layered", "wsdm", "layered_w"):
        return [("word", variant, word)]
    parts = [("word", "atire", {k: w * p.unigram for k, w in word.items()})]
    for kind, asked, w in (("near", near, p.ordered), ("loose", loose, p.unordered)):
        if not w or not asked:
            continue
        s = sources[kind]
        known = {k: n for k, n in asked.items() if s.stats["live"][s.at[k[1]]]}
        idf = {k: s.stats["idf"][s.at[k[1]]] for k in known}
        if variant in ("wsdm", "layered_w"):
            sums, count = Counter(), Counter()
            for k, n in known.items():
                sums[k[0]] += idf[k] * n
                count[k[0]] += n
            known = {k: n * (idf[k] / (sums[k[0]] / count[k[0]])) ** p.beta for k, n in known.items()}
        parts.append((kind, "atire", {k: n * w for k, n in known.items()}))
    return parts


def leg(wide: DataFrame, name: str) -> DataFrame:
    """(query_id, doc_id, score) of one leg of what a scan gives."""
    return wide.where(F.col(name).isNotNull()).select("query_id", "doc_id", F.col(name).alias("score"))


def best(docs: DataFrame, queries: DataFrame, variant: str, k: int, p: Params = DEFAULT) -> DataFrame:
    """(query_id, doc_id, score) of the documents that can be among the k best of a query: ``top`` of them is ``top`` of ``score``, and all matches of a query with at most k are there."""
    found = scanned(docs, queries, (variant,), p)
    return score(docs, queries, variant, p) if found is None else leg(found.best(k), variant)


def score_terms(rows: DataFrame, terms: DataFrame, variant: str = "atire", p: Params = DEFAULT) -> DataFrame:
    """Scores of weighted terms (query_id, term, qtf); weights of 0 or less are skipped. Backoff counts as BM25+, layered as Atire."""
    own = {"sab": "plus", "layered": "atire", "layered_w": "atire"}.get(variant, variant)
    live = terms.where("qtf > 0")
    return summed(contributions(live, lx.build(rows, live), expression(own, p)))


def subword_backoff(rows: DataFrame, asked: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """BM25+ of each term with weight df / (df + gamma), and of its distinct character n-grams with the rest."""
    terms = lx.query_terms(asked)
    index = lx.build(rows, terms)
    share = F.coalesce(F.col("df") / (F.col("df") + F.lit(p.gamma)), F.lit(0.0))
    split = terms.join(index.stats.select("term", "df"), "term", "left").withColumn("share", share).drop("df")
    exact = split.select("query_id", "term", (F.col("qtf") * F.col("share")).alias("qtf")).where("qtf > 0")
    own = F.array_distinct(T.grams_of(F.col("term"), p.gram_min, p.gram_max))
    pieces = split.where("share < 1").select("query_id", F.explode(own).alias("term"), (F.col("qtf") * (1 - F.col("share"))).alias("w"))
    pieces = pieces.groupBy("query_id", "term").agg(F.sum("w").alias("qtf"))
    wanted = terms.select(F.explode(T.grams_of(F.col("term"), p.gram_min, p.gram_max)).alias("term"))
    grams = lx.gram_index(rows, wanted, p.gram_min, p.gram_max, p.gram_prune)
    plus = expression("plus", p)
    return summed(contributions(exact, index, plus), contributions(pieces, grams, plus))


#: More distinct pairs of a query set than this are not shared with the tasks; they are joined instead.
MOST_PAIRS = 1_000_000


def _pair_postings(rows: DataFrame, near: DataFrame, loose: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(term, doc_id, tf) of the ordered and of the unordered pairs."""
    n = near.select("term").unionByName(loose.select("term")).distinct().limit(MOST_PAIRS + 1).count()
    if n > MOST_PAIRS:
        count = lambda df, terms: lx.build(df, terms).postings.select("term", "doc_id", "tf")
        return count(lx.ordered(rows), near), count(lx.unordered(rows, window), loose)
    both = keep(pairs.counted(rows, near, loose, window), "pairs")
    return tuple(both.where(F.col("leg") == leg).drop("leg") for leg in (0, 1))


def _pair_leg(tf: DataFrame, asked: DataFrame, words: LexIndex, p: Params, weight: float, weighted_pairs: bool) -> DataFrame:
    """One bigram leg: Atire on bigram counts with the lengths in words."""
    index = lx.from_postings(words.docs, tf, corpus=words.corpus)
    terms = asked
    if weighted_pairs:
        known = asked.join(index.stats.select("term", "idf"), "term")
        mean = known.groupBy("query_id").agg((F.sum(F.col("idf") * F.col("qtf")) / F.sum("qtf")).alias("mean"))
        terms = known.join(mean, "query_id").select("query_id", "term", (F.col("qtf") * F.pow(F.col("idf") / F.col("mean"), F.lit(p.beta))).alias("qtf"))
    return weighted(contributions(terms, index, expression("atire", p)), weight)


def dependence(rows: DataFrame, asked: DataFrame, p: Params = DEFAULT, variant: str = "atire", weighted_pairs: bool = False) -> DataFrame:
    """Sequential dependence: terms, ordered neighbours, and pairs within a window.

    With ``weighted_pairs`` each pair's weight is scaled by (idf / mean idf of
    the query's pairs of that leg) ** beta. One pass over the documents counts
    both kinds of pairs.
    """
    terms = lx.query_terms(asked)
    index = lx.build(rows, terms)
    near = lx.query_terms(asked.select("query_id", T.ordered_bigrams(F.col("terms")).alias("terms")))
    loose = asked.select("query_id", F.filter(T.unordered_bigrams(F.col("terms"), 1), lambda x: F.element_at(F.split(x, " "), 1) != F.element_at(F.split(x, " "), 2)).alias("terms"))
    loose = lx.query_terms(loose)
    parts = [weighted(contributions(terms, index, expression(variant, p)), p.unigram)]
    if p.ordered or p.unordered:
        for tf, asked_pairs, w in zip(_pair_postings(rows, near, loose, p.window), (near, loose), (p.ordered, p.unordered)):
            if w:
                parts.append(_pair_leg(tf, asked_pairs, index, p, w, weighted_pairs))
    return summed(*parts)


def fields(docs: DataFrame, aux: DataFrame, queries: DataFrame, aux_queries: DataFrame, body: float = 0.85, extra: float = 0.15, variant: str = "atire", p: Params = DEFAULT) -> DataFrame:
    """Linear fusion of two fields, each with its own lengths and statistics: ``docs`` and ``aux`` are (doc_id, terms), the queries (query_id, terms)."""
    parts = []
    for rows, asked, w in ((docs, queries, body), (aux, aux_queries, extra)):
        if w:
            terms = lx.query_terms(asked)
            parts.append(weighted(contributions(terms, lx.build(rows, terms), expression(variant, p)), w))
    return summed(*parts)


def recipe_by_length(index_corpus: DataFrame, long_docs: float = 250.0) -> DataFrame:
    """(recipe, ltd_alpha): sublinear length correction where documents are long."""
    long_ = F.col("avg_dl") > long_docs
    return index_corpus.select(F.when(long_, "ltd").otherwise("atire").alias("recipe"), F.when(long_, 0.7).otherwise(1.0).alias("ltd_alpha"), "avg_dl")
