"""Language identification word by word, with a linear-chain conditional random field.

A word's score for each language comes from its affixes, its inner n-grams and
a lexicon; learned transitions tie neighbours together. Forward-backward gives
each word of a text, code-switched or not, its marginal probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import prepare

U = np.uint64
BUCKETS, DOCS_PER_LANG, WINDOW, LEAST_SHARE, SEED = 1 << 17, 300, 32, 0.4, 11
NGRAMS, AFFIXES = (1, 2, 3, 4), (1, 2, 3, 4)


@dataclass
class Model:
    """Weights of hashed features and of lexicon classes (the last class: unknown), transitions, and scores at the start."""

    langs: list[str]
    weight: np.ndarray
    lexicon: np.ndarray
    lexicon_class: np.ndarray
    lexicon_weight: np.ndarray
    transition: np.ndarray
    start: np.ndarray


def word_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, first) of words as byte ranges: n-grams of 1 to 4 bytes, prefixes and suffixes of 1 to 4, all hashed to buckets."""
    n, size = len(starts), ends - starts
    count = sum(np.maximum(size - k + 1, 0) for k in NGRAMS) + 2 * len(AFFIXES)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=first[1:])
    out = np.empty(first[-1], np.int32)
    at = first[:-1].copy()
    b = buf.astype(U) + U(1)
    mask = U(buckets - 1)

    def bucket(h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + U(kind << 40)) * U(0x9E3779B97F4A7C15)
        return ((h ^ (h >> U(29))) & mask).astype(np.int32)

    grams = np.zeros(len(buf), U)
    for k in range(1, 5):
        grams[: max(0, len(buf) - k + 1)] = grams[: max(0, len(buf) - k + 1)] * U(257) + b[k - 1 :]
        c = np.maximum(size - k + 1, 0)
        inside = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        out[np.repeat(at, c) + inside] = bucket(grams[np.repeat(starts, c) + inside], k)
        at += c
        full = size >= k
        head, tail = np.full(n, k, U), np.full(n, k, U)
        head[full], tail[full] = grams[starts[full]], grams[ends[full] - k]
        out[at], out[at + 1] = bucket(head, 8 + k), bucket(tail, 16 + k)
        at += 2
    return out, first


def lexicon_of(model: Model, h: np.ndarray) -> np.ndarray:
    """The lexicon class of each word hash."""
    if not len(model.lexicon):
        return np.full(len(h), len(model.langs))
    i = np.minimum(np.searchsorted(model.lexicon, h), len(model.lexicon) - 1)
    return np.where(model.lexicon[i] == h, model.lexicon_class[i], len(model.langs))


def emissions(model: Model, buf, starts, ends, h) -> np.ndarray:
    f, first = word_features(buf, starts, ends, len(model.weight))
    if not len(starts):
        return np.zeros((0, len(model.langs)), np.float32)
    return np.add.reduceat(model.weight[f], first[:-1], axis=0) + model.lexicon_weight[lexicon_of(model, h)]


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The probabilities of each word's labels, by forward-backward over all chains first[d]:first[d + 1] at once."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, at = size[order], first[:-1][order]
    e = np.exp(emission - emission.max(1, keepdims=True)) if len(emission) else emission
    move = np.exp(transition - transition.max()).astype(e.dtype)
    top = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(top + 1), side="right")  # chains at least so long
    forward, out = np.empty_like(e), np.empty_like(e)
    a = np.exp(start - start.max()).astype(e.dtype)[None, :] * e[at[: alive[1]]] if top else None
    for t in range(top):
        rows = at[: alive[t + 1]] + t
        if t:
            a = (a[: len(rows)] @ move) * e[rows]
        a /= a.sum(1, keepdims=True)
        forward[rows] = a
    back = np.ones((0, e.shape[1]), e.dtype)
    turned = move.T.copy()
    for t in range(top - 1, -1, -1):
        rows = at[: alive[t + 1]] + t
        ends = np.ones((len(rows) - len(back), e.shape[1]), e.dtype)
        b = np.concatenate([back, ends]) if len(ends) else back
        p = forward[rows] * b
        out[rows] = p / p.sum(1, keepdims=True)
        back = (b * e[rows]) @ turned
        back /= back.sum(1, keepdims=True)
    return out


def label(model: Model, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, best label, first) of the words of a column; a model without languages labels none."""
    if not model.langs:
        return np.zeros((0, 0), np.float32), np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    buf, _, starts, ends, first, h = tv.words(column)
    if not len(starts):
        return np.zeros((0, len(model.langs)), np.float32), np.zeros(0, np.int64), first
    _, at, which = np.unique(h, return_index=True, return_inverse=True)
    width = ends[at] - starts[at]
    stop = np.cumsum(width)
    own = buf[np.repeat(starts[at] - (stop - width), width) + np.arange(width.sum())]
    e = emissions(model, own, stop - width, stop, h[at])
    p = marginals(e[which], first, model.transition, model.start)
    return p, p.argmax(1), first


def fit(texts: list[str], langs: list[str], seed: int = SEED, sequences: int = 6000, epochs: int = 6, buckets: int = BUCKETS) -> Model:
    """A model from texts of known language.

    Training sequences are windows of 32 words, half of one language and half
    spliced of runs of 2 to 12 words of several. The lexicon holds words seen
    three times or more and nine times in ten in one language. AdaGrad climbs
    the conditional likelihood, whose gradient forward-backward gives.
    """
    names = sorted(set(langs))
    if not names:
        none = np.zeros((0, 0), np.float32)
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0, U), np.zeros(0, np.int64), np.zeros((1, 0), np.float32), none, np.zeros(0, np.float32))
    y_doc = np.array([names.index(x) for x in langs], np.int64)
    buf, _, starts, ends, first, h = tv.words(pa.array(texts, pa.large_string()))
    k, rng = len(names), np.random.default_rng(seed)
    doc = tv.doc_of(first)
    known, which = np.unique(h, return_inverse=True)
    seen = np.zeros((len(known), k))
    np.add.at(seen, (which, y_doc[doc]), 1)
    total, top = seen.sum(1), seen.max(1) if len(seen) else seen.sum(1)
    sure = (total >= 3) & (top >= 0.9 * total)
    model = Model(names, np.zeros((buckets, k), np.float32), known[sure], seen[sure].argmax(1), np.zeros((k + 1, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    usable = [np.flatnonzero((np.diff(first) >= 1) & (y_doc == c)) for c in range(k)]
    present = [c for c in range(k) if len(usable[c])]
    if not present:
        return model

    def run(c: int, n: int) -> np.ndarray:
        d = usable[c][rng.integers(len(usable[c]))]
        a = first[d] + rng.integers(max(1, first[d + 1] - first[d] - n + 1))
        return np.arange(a, min(a + n, first[d + 1]))

    windows = np.zeros((sequences, WINDOW), np.int64)
    for i in range(sequences):
        parts, left, c = [], WINDOW, present[rng.integers(len(present))]
        while left > 0:
            if i % 2:
                c = present[rng.integers(len(present))]
            part = run(c, int(min(left, rng.integers(2, 13) if i % 2 else left)))
            parts.append(part)
            left -= len(part)
        windows[i] = np.concatenate(parts)
    chosen, flat = np.unique(windows, return_inverse=True)
    windows = flat.reshape(windows.shape)
    f, edge = word_features(buf, starts[chosen], ends[chosen], buckets)
    lex, gold = lexicon_of(model, h[chosen]), y_doc[doc[chosen]]
    memory = [np.full(x.shape, 1e-2, np.float32) for x in (model.weight, model.lexicon_weight, model.transition, model.start)]
    batch = 500
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(sequences), max(1, sequences // batch)):
            w = windows[part].reshape(-1)
            words, inv = np.unique(w, return_inverse=True)
            c = edge[words + 1] - edge[words]
            at = np.cumsum(c) - c
            g = f[np.repeat(edge[words] - at, c) + np.arange(c.sum())]
            e = (np.add.reduceat(model.weight[g], at, axis=0) + model.lexicon_weight[lex[words]])[inv]
            chain = np.arange(len(part) + 1) * WINDOW
            p = marginals(e, chain, model.transition, model.start)
            want = np.eye(k, dtype=np.float32)[gold[w]]
            d = (want - p) / len(part)
            per_word = np.zeros((len(words), k), np.float32)
            np.add.at(per_word, inv, d)
            spread = np.repeat(per_word, c, axis=0)
            gw = np.stack([np.bincount(g, spread[:, j], minlength=buckets) for j in range(k)], 1).astype(np.float32)
            gl = np.zeros_like(model.lexicon_weight)
            np.add.at(gl, lex[w], d)
            # expected transitions: p(a, b) is in proportion to p(a) * move(a, b) * p(b | next) for neighbours
            pe, we = p.reshape(-1, WINDOW, k), want.reshape(-1, WINDOW, k)
            gt = np.einsum("sta,stb->ab", we[:, :-1], we[:, 1:]) - _pairs(e, p, model, len(part))
            grads = gw, gl, gt.astype(np.float32) / len(part), (we[:, 0] - pe[:, 0]).mean(0)
            for x, m, gr in zip((model.weight, model.lexicon_weight, model.transition, model.start), memory, grads):
                m += gr * gr
                x += 0.3 * gr / np.sqrt(m)
    return model


def _pairs(e: np.ndarray, p: np.ndarray, model: Model, n: int) -> np.ndarray:
    """Expected counts of neighbouring label pairs in n windows, by forward and backward messages."""
    k = e.shape[1]
    x = np.exp(e - e.max(1, keepdims=True)).reshape(n, WINDOW, k)
    move = np.exp(model.transition - model.transition.max())
    fwd, bwd = np.empty_like(x), np.ones_like(x)
    a = np.exp(model.start - model.start.max()) * x[:, 0]
    for t in range(WINDOW):
        if t:
            a = (fwd[:, t - 1] @ move) * x[:, t]
        fwd[:, t] = a / a.sum(1, keepdims=True)
    for t in range(WINDOW - 2, -1, -1):
        b = (bwd[:, t + 1] * x[:, t + 1]) @ move.T
        bwd[:, t] = b / b.sum(1, keepdims=True)
    out = np.zeros((k, k))
    for t in range(WINDOW - 1):
        joint = fwd[:, t, :, None] * move[None] * (x[:, t + 1] * bwd[:, t + 1])[:, None, :]
        out += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return out


def train(docs: DataFrame, per_lang: int = DOCS_PER_LANG, seed: int = SEED) -> Model:
    """A model from ``per_lang`` documents of each value of column ``lang`` (those with the least hashes of doc_id), their whole texts; ids are chosen first, so texts of others never move. Of rows that repeat an id and a language one counts."""
    from pyspark.sql import Window

    ids = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang").distinct()
    h = F.xxhash64("doc_id", F.lit(seed))
    chosen = ids.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id"))).where(F.col("rn") <= per_lang).select("doc_id", "lang")
    # at most ``per_lang`` ids a language
    met = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sorted(met.collect(), key=lambda r: (r["doc_id"], r["lang"], r["text"] or ""))
    return fit([r["text"] or "" for r in rows], [r["lang"] for r in rows], seed)


def doc_stats(model: Model, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, shares by language, mean confidence, switches, best labels, first) of each text."""
    p, best, first = label(model, column)
    n, k = np.diff(first), max(1, len(model.langs))
    share = np.zeros((len(n), k))
    np.add.at(share, (tv.doc_of(first), best), 1)
    share /= np.maximum(n, 1)[:, None]
    sums = np.r_[0.0, np.cumsum(p.max(1) if len(p) else np.zeros(0))]
    sure = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
    change = np.r_[0, np.cumsum(np.r_[0, best[1:] != best[:-1]])] if len(best) else np.zeros(1, np.int64)
    switches = np.where(n > 0, change[first[1:]] - change[np.minimum(first[:-1] + 1, len(change) - 1)], 0)
    return n, share, sure, switches, best, first


def accepts(n: np.ndarray, share: np.ndarray, least: float) -> np.ndarray:
    return (n > 0) & (share.max(1) >= least)


_RUN = pa.struct([("lang", pa.string()), ("words", pa.int32())])
SCHEMA = "doc_id long, lang_found string, n_words long, share double, confidence double, switches long, runs array<struct<lang:string,words:int>>, kept boolean"


def _identify(model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = pa.array(m.langs or ["und"])
        for whole in batches:
            for b in tv.slices(whole):
                n, share, sure, switches, best, first = doc_stats(m, b.column("text"))
                new = np.r_[True, best[1:] != best[:-1]] if len(best) else np.zeros(0, bool)
                new[first[:-1][n > 0]] = True
                at = np.flatnonzero(new)
                sizes = np.diff(np.r_[at, len(best)]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([names.take(pa.array(best[at])), pa.array(sizes)], fields=list(_RUN))
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), pairs)
                top = pa.array(share.argmax(1), mask=n == 0)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()), names.take(top), pa.array(n.astype(np.int64)), pa.array(share.max(1)), pa.array(sure), pa.array(switches.astype(np.int64)), runs, pa.array(accepts(n, share, least))],
                    names=["doc_id", "lang_found", "n_words", "share", "confidence", "switches", "runs", "kept"],
                )

    return run


def identify(docs: DataFrame, model: Model | None = None, least: float = LEAST_SHARE) -> DataFrame:
    """One row a document: its main language, the share of its words in it, the mean confidence, the number of switches, the labels of its words as runs, and whether it is kept.

    The model is trained on the documents' own ``lang`` if none is given. A
    document is rejected if it has no word or if its main language has less
    than ``least`` of its words. A null, empty or wordless text has language
    null, no runs, and is rejected; a null lang is not trained on; a null
    doc_id stays null; equal shares go to the language first by name; rows that
    repeat are labelled one by one; a text of any length is labelled whole. Where no row has a language to train on, no
    word is labelled and all are rejected. Other columns, whatever their names, are
    not read; an empty table gives no rows. No shuffle of texts takes place.
    """
    spark = prepare(docs.sparkSession)
    own = spark.sparkContext.broadcast(model or train(docs))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_identify(own, least), SCHEMA)


def _keep(model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in tv.slices(whole):
                n, share, *_ = doc_stats(model.value, b.column("text"))
                yield b.filter(pa.array(accepts(n, share, least)))

    return run


def keep_identified(docs: DataFrame, model: Model | None = None, least: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns.

    Null, empty and wordless texts go; a null doc_id or lang changes nothing;
    repeated rows and texts of any length are judged one by one and whole; an
    empty table stays empty.
    """
    spark = prepare(docs.sparkSession)
    own = spark.sparkContext.broadcast(model or train(docs))
    return docs.mapInArrow(_keep(own, least), docs.schema)
