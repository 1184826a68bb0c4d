"""Document fragments: ranked sentences with sparse signatures, a centroid and the whole text, chosen greedily.

Ranking is one Arrow stage; signatures come from joins with the term
statistics, so no statistics are shared with workers; the greedy choice runs on
each document's few candidates.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwood.functions import text as T
from tarnwood.functions import vectors as V
from tarnwood.session import keep, prepare

from . import embed, pairs, strategies, textrank

WORD_VECTORS = ("richcov_sif", "richcov_bsif")
BUILDERS = ("basic", "rich", "rich_covered", "rich_mmr", "rich_asymmetric", "rich_budgeted", *WORD_VECTORS)


def ranked_sentences(docs: DataFrame, top: int = 4, position: float = 0.0) -> DataFrame:
    """(doc_id, place, idx, sentence): the best of 4 * top sentences, their scores blended with 1 / (1 + index) where asked."""
    found = textrank.rank_docs(docs, 4 * top)
    score = F.lit(1 - position) * F.col("score") + F.lit(position) / (1 + F.col("idx")) if position > 0 else F.col("score")
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round(score, 9)), "idx")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("doc_id", "place", "idx", "sentence")


def candidates(docs: DataFrame, stats: DataFrame, top: int = 4, terms: int = 8, position: float = 0.0) -> DataFrame:
    """(doc_id, place, kind, text, sig map<string,double>): ranked sentences, and the document under place 0 with twice the terms. A sentence without a signature is dropped."""
    parts = ranked_sentences(docs, top, position).select("doc_id", "place", F.lit("sentence").alias("kind"), F.col("sentence").alias("text"))
    parts = parts.unionByName(docs.select("doc_id", F.lit(0).alias("place"), F.lit("document").alias("kind"), F.coalesce("text", F.lit("")).alias("text")))
    return signed(parts, stats, terms)


def signed(parts: DataFrame, stats: DataFrame, terms: int = 8) -> DataFrame:
    """``parts(doc_id, place, kind, text)`` with their signatures; the document, at place 0, has twice the terms."""
    keyed = parts.withColumn("fid", F.struct("doc_id", "place"))
    own = keyed.select(F.col("fid").alias("doc_id"), T.terms("text").alias("terms"))
    sig = strategies.signatures(own, stats, 2 * terms)
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("weight", 9)), "term")
    sig = sig.withColumn("rn", F.row_number().over(order)).where((F.col("rn") <= terms) | (F.col("doc_id.place") == 0))
    maps = sig.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("sig"))
    return keyed.join(maps.withColumnRenamed("doc_id", "fid"), "fid", "left").where("kind = 'document' or sig is not null").select("doc_id", "place", "kind", "text", F.coalesce("sig", F.create_map().cast("map<string,double>")).alias("sig"))


def overlap(a: dict, b: dict) -> float:
    """Shared weight over the lesser weight sum; 0 if either is empty."""
    if not a or not b:
        return 0.0
    return sum(min(w, b[t]) for t, w in a.items() if t in b) / max(1e-6, min(sum(a.values()), sum(b.values())))


def merge_max(a: dict, b: dict, most: int) -> dict:
    """The union with the greater weights, cut to the heaviest terms."""
    out = {t: max(a.get(t, 0.0), b.get(t, 0.0)) for t in {*a, *b}}
    return dict(sorted(out.items(), key=lambda kv: (-kv[1], kv[0]))[:most])


def choose(sigs: list[dict], anchors: int, builder: str = "rich_covered", sentence_cap: float = 0.6, anchor_cap: float = 0.9, redundancy: float = 0.5, least_sentence: float = 0.0, least_anchor: float = 0.0, most_sentences: int = 4, most_anchors: int = 1, novelty: float = 0.2) -> list[int]:
    """Which candidates stay, in the order taken. The last two are anchors, also where only sentences are left (``anchors`` says how many there really are; it is kept for callers)."""
    n = len(sigs)
    base = n - 2 if n >= 2 else n
    if builder in ("basic", "rich") or n == 0:
        return list(range(n))
    worst = lambda i, kept: max((overlap(sigs[i], sigs[k]) for k in kept), default=0.0)
    cap = lambda i: sentence_cap if i < base else anchor_cap
    step = 0.35 / (base - 1) if base > 1 else 0.0
    salience = [1 - step * i if i < base else (0.72 if i == base else 0.60) for i in range(n)]
    kept: list[int] = []
    if builder == "rich_covered":
        for i in range(n):
            if not kept or worst(i, kept) <= cap(i):
                kept.append(i)
    elif builder == "rich_budgeted":
        used = [0, 0]
        for i in range(n):
            side = int(i >= base)
            if used[side] < (most_sentences, most_anchors)[side] and (not kept or 1 - worst(i, kept) >= novelty):
                kept.append(i)
                used[side] += 1
    else:
        left = list(range(n))
        if builder == "rich_asymmetric":
            for i in range(base):
                if not kept or worst(i, kept) <= sentence_cap:
                    kept.append(i)
            left = list(range(base, n))
        while left:
            # rounded, so that a value of 0 doesn't depend on the order of sums
            value = {i: round(salience[i] - redundancy * (o := worst(i, kept)) - max(0.0, o - cap(i)), 12) for i in left}
            best = max(left, key=lambda i: (value[i], -i))
            if value[best] < (least_sentence if best < base else least_anchor):
                break
            kept.append(best)
            left.remove(best)
    return kept or [0]


def assembled(sentences: list, doc, builder: str, terms: int, **caps) -> list[tuple[str, np.ndarray, dict]]:
    """(kind, vector, signature) of the fragments of one document that stay.

    ``sentences`` are (vector, signature) by rank, ``doc`` those of the whole
    text. The builders on word vectors give the centroid the greatest weights
    of all sentences, and the whole text its short signature.
    """
    unit = lambda v: float(np.sqrt((v**2).sum()))
    found = [("sentence", v, s) for v, s in sentences if unit(v) > 0 and s]
    whole = doc[1]
    short = dict(sorted(whole.items(), key=lambda kv: (-kv[1], kv[0]))[:terms])
    own = builder in WORD_VECTORS
    alone = not found
    if builder != "basic" or alone:
        if len(found) >= 2:
            c = np.mean([v for _, v, _ in found], axis=0)
            sig = functools.reduce(lambda a, b: merge_max(a, b, max(2 * terms, terms + 4)), (s for *_, s in found), {}) if own else short
            if unit(c) > 0 and sig:
                found.append(("centroid", c / unit(c), sig))
        if unit(doc[0]) > 0 and whole and (not own or alone or len(found) >= 2):
            found.append(("document", doc[0], short if own or builder == "basic" else whole))
    keep = choose([s for *_, s in found], 0, "rich_covered" if own else builder, **caps) if found else []
    return [found[i] for i in keep]


def build(docs: DataFrame, stats: DataFrame, config: embed.EncoderConfig = embed.COMPACT, builder: str = "rich_covered", top: int = 4, terms: int = 8, position: float = 0.0, table: DataFrame | None = None, bigrams: float = 0.5, shape: int = 0, **caps) -> DataFrame:
    """(doc_id, frag_idx, kind, vec, sig): the fragments of each document, vectors from the encoder; with ``shape`` what ``geometry.doc_topology`` says of the first so many.

    ``rich`` builders add the normalised mean of two or more sentence vectors
    and the whole document; a document without sentences is its own fragment.
    ``richcov_sif`` and ``richcov_bsif`` take weighted word vectors from
    ``table(token, vec)``, the latter with products of neighbours; without a
    table they are ``rich_covered``. Texts are ranked once, and a document's few
    fragments meet in one row.
    """
    if builder not in BUILDERS:
        raise ValueError(f"no builder {builder!r}")
    prepare(docs.sparkSession)
    if builder in WORD_VECTORS and table is None:
        builder = "rich_covered"
    parts = keep(candidates(docs, stats, top, terms, position), "candidates")
    if builder in WORD_VECTORS:
        worded = parts.withColumn("terms", T.terms("text"))
        encoded = sif_vectors(worded, table, stats, bigrams if builder == "richcov_bsif" else 0.0, carry=("place", "sig"))
    elif table is not None:
        encoded = sif_vectors(parts.withColumn("terms", T.terms("text")), table, None, carry=("place", "sig"))
    else:
        encoded = embed.encode(parts, config, carry=("place", "sig"))
    return gathered(encoded, builder, terms, shape, **caps)


def gathered(encoded: DataFrame, builder: str = "rich_covered", terms: int = 8, shape: int = 0, **caps) -> DataFrame:
    """(doc_id, frag_idx, kind, vec, sig) of candidates ``encoded(doc_id, place, vec, sig)``: a document's few meet in one row, and those that the builder chooses stay; with ``shape`` (doc_id, mean_sim, gap) of the first so many, where they are made."""
    rows = encoded.groupBy("doc_id").agg(F.collect_list(F.struct("place", "vec", "sig")).alias("parts"))
    prepare(encoded.sparkSession)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, frag_idx int, kind string, vec array<double>, sig map<string,double>"

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                out: list[list] = [[], [], [], [], []]
                for doc_id, group in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    made = [(p["place"], np.asarray(p["vec"], float), dict(p["sig"])) for p in sorted(group, key=lambda p: p["place"])]
                    doc = next((m[1:] for m in made if m[0] == 0), (np.zeros(0), {}))
                    for i, (what, v, sig) in enumerate(assembled([m[1:] for m in made if m[0]], doc, builder, terms, **caps)):
                        for column, value in zip(out, (doc_id, i, what, v, list(sig.items()))):
                            column.append(value)
                kinds = [b.schema.field(0).type, pa.int32(), pa.string(), pa.list_(pa.float64()), pa.map_(pa.string(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "frag_idx", "kind", "vec", "sig"])

    def shapes(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids, mean, gap = [], [], []
                for doc_id, group in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    made = [(p["place"], np.asarray(p["vec"], float), dict(p["sig"])) for p in sorted(group, key=lambda p: p["place"])]
                    doc = next((m[1:] for m in made if m[0] == 0), (np.zeros(0), {}))
                    kept = [v for _, v, _ in assembled([m[1:] for m in made if m[0]], doc, builder, terms, **caps)]
                    if kept:
                        for column, value in zip((ids, mean, gap), (doc_id, *outline(kept[:shape]))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(mean, pa.float64()), pa.array(gap, pa.float64())], names=["doc_id", "mean_sim", "gap"])

    if shape:
        return rows.mapInArrow(shapes, f"doc_id {kind}, mean_sim double, gap double")
    return rows.mapInArrow(run, schema)


def outline(vectors: list[np.ndarray]) -> tuple[float, float]:
    """(mean cosine, widest gap among the sorted cosines) of a document's few vectors; 0 with fewer than two."""
    if len(vectors) < 2:
        return 0.0, 0.0
    x = np.stack(vectors)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
    sims = np.sort((x @ x.T)[np.triu_indices(len(x), 1)])[::-1]
    return float(sims.mean()), float((sims[:-1] - sims[1:]).max()) if len(sims) > 1 else 0.0


#: Word vectors of more words than this are not shared with the tasks.
MOST_WORDS = 200_000


def sif_vectors(sentences: DataFrame, table: DataFrame, stats: DataFrame | None, bigrams: float = 0.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, vec) of ``sentences(doc_id, terms)``, with the columns to ``carry`` between them.

    Word vectors weighted by max(idf, 0.1), or by 1 without ``stats``, plus products of neighbours' vectors
    where asked, at unit length; zeros for a text without a known word. The word
    table has a bounded vocabulary, is counted, and is shared with its weights.
    """
    spark = prepare(sentences.sparkSession)
    weight = F.greatest(F.coalesce("idf", F.lit(0.0)), F.lit(0.1))
    if stats is None:
        known = table.select("token", "vec", F.lit(1.0).alias("w"))
    else:
        known = table.join(stats.select(F.col("term").alias("token"), "idf"), "token", "left").select("token", "vec", weight.alias("w"))
    rows = sorted(known.limit(MOST_WORDS + 1).collect(), key=lambda r: r["token"])
    if len(rows) > MOST_WORDS:
        raise ValueError(f"over {MOST_WORDS} words")
    dim = len(rows[0]["vec"]) if rows else 0
    shared = spark.sparkContext.broadcast((pa.array([r["token"] for r in rows], pa.string()), np.array([r["vec"] for r in rows], float).reshape(len(rows), dim), np.array([r["w"] for r in rows], float)))
    names = ["doc_id", *carry]

    def run(batches):
        vocab, x, w = shared.value
        for whole in batches:
            for b in pairs.slices(whole, max(1_000, 4_000_000 // max(1, dim))):
                ids, row = pairs.numbered(b.column("terms"), vocab)
                out = np.zeros((b.num_rows, dim))
                live = ids >= 0
                np.add.at(out, row[live], x[ids[live]] * w[ids[live]][:, None])
                if bigrams:
                    i, j, r = pairs.within(ids, row, 1)
                    np.add.at(out, r, x[i] * x[j] * (bigrams * np.sqrt(w[i] * w[j]))[:, None])
                n = np.sqrt((out * out).sum(1, keepdims=True))
                out = np.divide(out, n, out=np.zeros_like(out), where=n > 0)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * dim), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), vec], names=[*names, "vec"])

    kinds = ", ".join(f"{n} {sentences.schema[n].dataType.simpleString()}" for n in names)
    return sentences.select(*names, "terms").mapInArrow(run, f"{kinds}, vec array<double>")


def packed(fragments: DataFrame) -> DataFrame:
    """The fragments with vectors of half the size: the upper halves of single floats."""
    return fragments.withColumn("vec", V.to_bf16(F.col("vec").cast("array<float>")))


def unpacked(fragments: DataFrame) -> DataFrame:
    """Packed fragments with vectors of floats again, as reranking takes them."""
    return fragments.withColumn("vec", V.from_bf16(F.col("vec")))
