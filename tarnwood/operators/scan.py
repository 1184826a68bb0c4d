"""Scores of a whole query set where the documents are: two passes over the words, no shuffle of occurrences.

The first pass counts the statistics of the wanted keys (words, character
n-grams, word pairs), the second scores each document for all queries at once
and keeps, of each task, what can still be among the best: the k best of each
query and leg, or given pairs, or sums. What is shuffled is bounded by tasks,
queries and k, not by the pairs of queries and documents. The joins of
``rankers`` do the same for any table; they take over where ids repeat, since
rows of one document then count together, and where a query set is too large
to be shared with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwood.session import prepare

from . import pairs

#: More queries, or more (query, key) weights, than these are joined instead.
MOST_QUERIES, MOST_WEIGHTS = 20_000, 2_000_000
#: Cells of a tile (documents times queries), and products made at once.
CELLS, PRODUCTS = 1_000_000, 1_000_000
#: Cells of a matrix of weights (keys by queries) that is written out.
MATRIX = 4_000_000
#: Words whose keys are found at once.
WORDS = 100_000


@dataclass
class Source:
    """Keys of one kind: word, gram, near (neighbours in order), loose (in a window, in alphabetical order), or bigram, which is near with lengths in bigrams."""

    kind: str
    keys: list[str]
    window: int = 8
    least: int = 3
    most: int = 4
    prune: float = 0.0
    stats: dict = field(default_factory=dict)

    def __post_init__(self):
        self.keys = sorted(set(self.keys))
        if self.kind in ("near", "loose", "bigram"):
            parts = [k.split(" ") for k in self.keys]
            self.vocab = pa.array(sorted({w for p in parts for w in p}), pa.string())
            at = {w: i for i, w in enumerate(self.vocab.to_pylist())}
            code = np.array([at[a] * max(1, len(at)) + at[b] for a, b in parts], np.int64)
            order = np.argsort(code)
            self.codes, self.keys = code[order], [self.keys[i] for i in order]
        else:
            self.vocab = pa.array(self.keys, pa.string())
        self.at = {k: i for i, k in enumerate(self.keys)}
        if self.kind == "gram":
            # other than ASCII n-grams have no number of their own; they are looked up by name
            own = [k for k in self.keys if k.isascii() and len(k) < 8]
            code = np.array([packed(np.frombuffer(k.encode(), np.uint8), np.zeros(1, np.int64), len(k))[0] for k in own], np.int64)
            order = np.argsort(code)
            self.codes, self.places = code[order], np.array([self.at[k] for k in own], np.int64)[order]

    def postings(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, tf) of the keys in a batch, and the length of every row."""
        terms = b.column("terms")
        size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if self.kind == "gram":
            return self._grams(terms, size)
        ids, row = pairs.numbered(terms, self.vocab)
        if self.kind == "word":
            live = ids >= 0
            code = row[live] * len(self.keys) + ids[live]
        else:
            found, v = [np.zeros(0, np.int64)], max(1, len(self.vocab))
            for d in range(1, (self.window if self.kind == "loose" else 1) + 1 if self.keys else 1):
                x, y, r = pairs.within(ids, row, d)
                c = np.minimum(x, y) * v + np.maximum(x, y) if self.kind == "loose" else x * v + y
                k = np.minimum(np.searchsorted(self.codes, c), len(self.codes) - 1)
                hit = self.codes[k] == c
                found.append(r[hit] * len(self.keys) + k[hit])
            code = np.concatenate(found)
        code, tf = np.unique(code, return_counts=True)
        r, k = np.divmod(code, max(1, len(self.keys)))
        return r, k, tf, np.maximum(size - 1, 0) if self.kind == "bigram" else size

    def _grams(self, terms: pa.ListArray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        flat = terms.flatten().dictionary_encode()
        row, w = np.repeat(np.arange(len(size)), size), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = flat.dictionary
        chars = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
        length = sum(np.maximum(0, chars - (g - 1)) for g in range(self.least, self.most + 1))
        dl = np.bincount(row, length[w] if len(w) else None, len(size)).astype(np.int64)
        raw = "".join(names.to_pylist()).encode()
        if len(raw) == chars.sum() and self.most < 8:
            buf, of = np.frombuffer(raw, np.uint8), np.repeat(np.arange(len(names)), chars)
            word, every = [], []
            for g in range(self.least, self.most + 1):
                if len(buf) < g or not len(self.keys):
                    continue
                at = np.flatnonzero(of[: len(of) - g + 1] == of[g - 1 :])
                code = packed(buf, at, g)
                k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[k] == code
                word.append(of[at[hit]])
                every.append(self.places[k[hit]])
            word, every = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (word, every))
            every = every[np.argsort(word, kind="stable")]
            n_own = np.bincount(word, minlength=len(names))
        else:
            own = [np.array([self.at[x] for x in grams(t, self.least, self.most) if x in self.at], np.int64) for t in names.to_pylist()]
            n_own, every = np.array([len(x) for x in own], np.int64), np.concatenate([*own, np.zeros(0, np.int64)])
        code, n = np.unique(row * max(1, len(names)) + w, return_counts=True)
        r, w = np.divmod(code, max(1, len(names)))
        rep, at = spread(np.r_[0, np.cumsum(n_own)], w)
        code, inverse = np.unique(r[rep] * max(1, len(self.keys)) + every[at], return_inverse=True)
        tf = np.bincount(inverse, n[rep], len(code)).astype(np.int64)
        return *np.divmod(code, max(1, len(self.keys))), tf, dl


def packed(buf: np.ndarray, at: np.ndarray, g: int) -> np.ndarray:
    """The g bytes from each place as a number, different for each length."""
    code = np.full(len(at), 1, np.int64)
    for i in range(g):
        code = (code << 8) | buf[at + i]
    return code


def grams(term: str, least: int, most: int) -> list[str]:
    return [term[i : i + g] for g in range(least, most + 1) for i in range(len(term) - g + 1)]


def spread(starts: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``k``, place in the lists) of every element of the lists that ``k`` names; list i lies from starts[i] to starts[i + 1]."""
    n = starts[k + 1] - starts[k]
    rep = np.repeat(np.arange(len(k)), n)
    return rep, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[k], n)


def value(variant: str, p, s: dict, k: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
    """What ``rankers.expression`` says, of arrays."""
    tf, dl = tf.astype(float), dl.astype(float)
    if variant == "hits":
        return np.ones(len(tf))
    n, total, avg_dl, ttf, idf = s["n"], s["total"], s["avg_dl"], s["ttf"][k].astype(float), s["idf"][k]
    ratio = dl / avg_dl
    norm = lambda x: 1 - p.b + p.b * x
    sat = lambda x: tf * (p.k1 + 1) / (tf + p.k1 * norm(x))
    if variant == "atire":
        return idf * sat(ratio)
    if variant == "ltd":
        return idf * sat(ratio**p.ltd_alpha)
    if variant == "plus":
        return idf * (sat(ratio) + p.delta)
    if variant == "bm25l":
        c = tf / norm(ratio)
        return idf * (p.k1 + 1) * (c + p.delta) / (p.k1 + p.delta + c)
    if variant == "dcm":
        return np.log1p(tf * total / ((p.dcm_alpha if p.dcm_alpha > 0 else avg_dl) * ttf))
    two_pi = 6.283185307179586
    if variant == "pl2":
        tfn = tf * np.log2(1 + p.pl2_c * avg_dl / dl)
        return (tfn * np.log2(tfn * n / ttf) + (ttf / n - tfn) * 1.4426950408889634 + 0.5 * np.log2(two_pi * tfn)) / (tfn + 1)
    part = tf < dl
    share = np.where(part, tf / dl, 0.5)
    info = tf * np.log2(tf * avg_dl / dl * n / ttf) + 0.5 * np.log2(two_pi * tf * (1 - share))
    if variant == "dlh13":
        return np.where(part, info / (tf + 0.5), 0.0)
    if variant == "dph":
        return np.where(part, (1 - share) ** 2 / (tf + 1) * info, 0.0)
    raise ValueError(variant)


def unique_ids(rows: DataFrame) -> bool:
    """Whether every row has a ``doc_id`` of its own."""
    again = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    return again.limit(1).count() == 0


def tiles(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, most):
            yield whole.slice(at, most)


def runs(tile: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row, run) of a tile, a run having about ``WORDS`` words."""
    at = 0
    for b in pairs.slices(tile, WORDS):
        yield at, b
        at += b.num_rows


def count(rows: DataFrame, sources: dict[str, Source]) -> None:
    """Fills the statistics of the sources: df, ttf and idf of each key, and the corpus's n, total and avg_dl."""
    spark = prepare(rows.sparkSession)
    shared = spark.sparkContext.broadcast(list(sources.values()))

    def run(batches):
        own = shared.value
        df, ttf = ([np.zeros(len(s.keys), np.int64) for s in own] for _ in range(2))
        n, total = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for whole in batches:
            for _, b in runs(whole):
                for i, s in enumerate(own):
                    _, k, tf, dl = s.postings(b)
                    df[i] += np.bincount(k, minlength=len(s.keys))
                    ttf[i] += np.bincount(k, tf, len(s.keys)).astype(np.int64)
                    n[i] += b.num_rows
                    total[i] += dl.sum()
        for i in range(len(own)):
            at = np.flatnonzero(df[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, i, np.int32)), pa.array(np.r_[-1, at]), pa.array(np.r_[n[i], df[i][at]]), pa.array(np.r_[total[i], ttf[i][at]])], names=["s", "k", "df", "ttf"])

    got = rows.select("terms").mapInArrow(run, "s int, k long, df long, ttf long").groupBy("s", "k").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf")).toPandas()
    for i, s in enumerate(sources.values()):
        own = got[got.s == i]
        corpus, keyed = own[own.k < 0], own[own.k >= 0]
        n, total = int(corpus.df.sum()), int(corpus.ttf.sum())
        df, ttf = np.zeros(len(s.keys), np.int64), np.zeros(len(s.keys), np.int64)
        df[keyed.k.to_numpy()], ttf[keyed.k.to_numpy()] = keyed.df, keyed.ttf
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
        live = (df > 0) & ((df <= np.floor(s.prune * n)) if s.prune else True)
        s.stats = {"n": n, "total": total, "avg_dl": total / n if n else 0.0, "df": df, "ttf": ttf, "idf": idf, "live": live}


class Scan:
    """Legs over sources, ready to score: ``legs`` gives for each name its parts (source, variant, {(query number, key): weight})."""

    def __init__(self, rows: DataFrame, queries: list, kind: str, sources: dict[str, Source], legs: dict[str, list[tuple[str, str, dict]]], p, within: dict[str, str] | None = None, by: tuple[str, ...] = ()):
        # ``within`` names legs whose matches count only where another leg has one, ``by`` those that decide who is best (all, if none is named)
        self.rows, self.queries, self.kind, self.sources, self.legs, self.p, self.within, self.by = rows, queries, kind, sources, legs, p, within or {}, by or tuple(legs)

    @property
    def doc_kind(self) -> str:
        return self.rows.schema["doc_id"].dataType.simpleString()

    def _shared(self):
        """The parts of each leg with their weights by key; parts of equal weights share them."""
        made, packed = {}, []
        for leg, (_, parts) in enumerate(self.legs.items()):
            for name, variant, weights in parts:
                if id(weights) not in made:
                    s = self.sources[name]
                    cells = sorted((s.at[k], q, w) for (q, k), w in weights.items() if s.stats["live"][s.at[k]])
                    k = np.array([c[0] for c in cells], np.int64)
                    starts = np.searchsorted(k, np.arange(len(s.keys) + 1))
                    made[id(weights)] = (name, starts, np.array([c[1] for c in cells], np.int64), np.array([c[2] for c in cells], float))
                packed.append((leg, variant, made[id(weights)]))
        return self.rows.sparkSession.sparkContext.broadcast((self.sources, packed, len(self.legs), len(self.queries), self.p, [tuple(list(self.legs).index(x) for x in pair) for pair in self.within.items()]))

    @staticmethod
    def _tile(shared, tile: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(scores, matched) of a tile, legs by rows by queries."""
        sources, packed, n_legs, n_q, p, within = shared
        score, met = np.zeros((n_legs, tile.num_rows * n_q)), np.zeros((n_legs, tile.num_rows * n_q), bool)
        groups: dict[int, list] = {}
        full: dict[int, tuple] = {}
        for leg, variant, own in packed:
            groups.setdefault(id(own), [own]).append((leg, variant))
        for at, b in runs(tile):
            found: dict[str, tuple] = {}
            for (name, starts, qs, ws), *uses in groups.values():
                if name not in found:
                    found[name] = sources[name].postings(b)
                row, k, tf, dl = found[name]
                n = starts[k + 1] - starts[k]
                live = n > 0
                row, k, tf, n = row[live], k[live], tf[live], n[live]
                if not len(k):
                    continue
                parts = [(leg, value(variant, p, sources[name].stats, k, tf, dl[row])) for leg, variant in uses]
                keys = len(starts) - 1
                if keys * n_q <= MATRIX and n.sum() * 50 > b.num_rows * keys * n_q:
                    # most keys meet many queries: products of matrices are faster than single ones
                    if id(qs) not in full:
                        w, has = np.zeros((keys, n_q)), np.zeros((keys, n_q), np.float32)
                        at_key = np.repeat(np.arange(keys), np.diff(starts))
                        w[at_key, qs], has[at_key, qs] = ws, 1
                        full[id(qs)] = w, has
                    w, has = full[id(qs)]
                    x, one = np.zeros((b.num_rows, keys)), np.zeros((b.num_rows, keys), np.float32)
                    one[row, k] = 1
                    own, hit = slice(at * n_q, (at + b.num_rows) * n_q), ((one @ has) > 0).reshape(-1)
                    for leg, c in parts:
                        x[row, k] = c
                        score[leg, own] += (x @ w).reshape(-1)
                        met[leg, own] |= hit
                    continue
                cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(n) // PRODUCTS)) + 1).tolist(), len(k)]
                for a, z in zip(cuts, cuts[1:]):
                    rep, pos = spread(starts, k[a:z])
                    cell, w = (at + row[a:z][rep]) * n_q + qs[pos], ws[pos]
                    low, high = cell.min(), cell.max() + 1
                    for leg, c in parts:
                        score[leg, low:high] += np.bincount(cell - low, c[a:z][rep] * w, high - low)
                        met[leg, cell] = True
        for one, other in within:
            met[one] &= met[other]
            score[one][~met[one]] = 0
        shape = (n_legs, tile.num_rows, n_q)
        return score.reshape(shape), met.reshape(shape)

    def _frame(self, run) -> DataFrame:
        """(query_id, doc_id, a column a leg) of what ``run`` yields of the tasks' batches as (query number, documents, legs' scores)."""
        spark = prepare(self.rows.sparkSession)
        names = list(self.legs)
        ids = spark.sparkContext.broadcast(self.queries)
        kind = pa.string() if self.kind == "string" else None

        def named(batches):
            own = pa.array(ids.value, kind)
            for q, docs, score, met in run(batches):
                yield pa.RecordBatch.from_arrays([own.take(pa.array(q)), docs, *(pa.array(s, mask=~m) for s, m in zip(score, met))], names=["query_id", "doc_id", *names])

        return self.rows.select("doc_id", "terms").mapInArrow(named, ", ".join([f"query_id {self.kind}", f"doc_id {self.doc_kind}", *(f"`{n}` double" for n in names)]))

    def best(self, k: int, places: int = 8) -> DataFrame:
        """(query_id, doc_id, a column a leg, null where it has no match): all pairs that can be among the k best of a query in a leg, with all their legs' scores."""
        shared, n_q = self._shared(), max(1, len(self.queries))
        legs = [list(self.legs).index(name) for name in self.by]

        def pruned(q, docs, score, met):
            rank, keep = pc.rank(docs, tiebreaker="dense").to_numpy(), np.zeros(len(q), bool)
            for i in legs:
                at = np.flatnonzero(met[i])
                order = at[np.lexsort((rank[at], -np.round(score[i][at], places), q[at]))]
                first = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]]) if len(order) else np.zeros(0, np.int64)
                place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
                keep[order[place < k]] = True
            return q[keep], docs.filter(pa.array(keep)), score[:, keep], met[:, keep]

        def run(batches):
            held = None
            for tile in tiles(batches, max(1, CELLS // n_q)):
                s, m = Scan._tile(shared.value, tile)
                rounded = np.where(m, np.round(s, places), -np.inf)
                want = np.zeros(m.shape[1:], bool)
                for i in legs:
                    if tile.num_rows > k:
                        # all that reach the k-th value; ties are cut below
                        least = np.partition(rounded[i], tile.num_rows - k, axis=0)[tile.num_rows - k]
                        want |= m[i] & (rounded[i] >= least)
                    else:
                        want |= m[i]
                row, q = np.nonzero(want)
                new = q, tile.column(0).take(pa.array(row)), s[:, row, q], m[:, row, q]
                if held is not None:
                    new = np.r_[held[0], new[0]], pa.concat_arrays([held[1], new[1]]), np.hstack([held[2], new[2]]), np.hstack([held[3], new[3]])
                held = pruned(*new)
            if held is not None:
                yield held

        return self._frame(run)

    def pairs(self, pool: DataFrame) -> DataFrame:
        """(query_id, doc_id, a column a leg) of a pool(query_id, doc_id), whose size the caller has bounded; null where a leg has no match."""
        at = {q: i for i, q in enumerate(self.queries)}
        got = [(at[r[0]], r[1]) for r in pool.select("query_id", "doc_id").distinct().collect() if r[0] in at]
        shared = self._shared()
        kind = pa.string() if self.doc_kind == "string" else None
        docs = pa.array([d for _, d in got], kind)
        own = docs.dictionary_encode() if len(got) else pa.array([], pa.string()).dictionary_encode()
        code, q = own.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.array([q for q, _ in got], np.int64)
        order = np.argsort(code, kind="stable")
        wanted = self.rows.sparkSession.sparkContext.broadcast((own.dictionary, np.searchsorted(code[order], np.arange(len(own.dictionary) + 1)), q[order]))
        n_q = max(1, len(self.queries))

        def run(batches):
            names, starts, qs = wanted.value
            for whole in batches:
                if not len(names):
                    continue
                hit = pc.index_in(whole.column(0).cast(names.type), value_set=names)
                keep = pc.is_valid(hit)
                if not pc.any(keep).as_py():
                    continue
                b, d = whole.filter(keep), hit.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64)
                for at in range(0, b.num_rows, max(1, CELLS // n_q)):
                    tile = b.slice(at, max(1, CELLS // n_q))
                    s, m = Scan._tile(shared.value, tile)
                    row, pos = spread(starts, d[at : at + tile.num_rows])
                    yield qs[pos], tile.column(0).take(pa.array(row)), s[:, row, qs[pos]], m[:, row, qs[pos]]

        return self._frame(run)

    def above(self, wanted: DataFrame, places: int = 8) -> DataFrame:
        """(leg, query_id, doc_id, n): how many documents with a score above 0 stand before those of ``wanted(leg, query_id, doc_id, score)``, whose number the caller has bounded, by falling score and rising id."""
        spark, names = prepare(self.rows.sparkSession), list(self.legs)
        at = {q: i for i, q in enumerate(self.queries)}
        got = wanted.select("leg", "query_id", "doc_id", "score").collect()
        kind, own = pa.string() if self.doc_kind == "string" else None, pa.string() if self.kind == "string" else None
        docs = pa.array([r[2] for r in got], kind)
        group = np.array([names.index(r[0]) * len(at) + at[r[1]] for r in got], np.int64)
        level = np.round(np.array([r[3] for r in got], float), places)
        order = np.argsort(group, kind="stable")
        heads = np.searchsorted(group[order], np.arange(len(names) * len(at) + 1))
        asked, shared, ids = spark.sparkContext.broadcast((docs, level, order, heads)), self._shared(), spark.sparkContext.broadcast(self.queries)
        n_q = max(1, len(self.queries))

        def run(batches):
            docs, level, order, heads = asked.value
            n = np.zeros(len(level), np.int64)
            groups = np.flatnonzero(np.diff(heads))
            for tile in tiles(batches, max(1, CELLS // n_q)):
                s, m = Scan._tile(shared.value, tile)
                s = np.where(m & (s > 0), np.round(s, places), -np.inf)
                for g in groups:
                    column, mine = s[g // n_q, :, g % n_q], order[heads[g] : heads[g + 1]]
                    ranked = np.sort(column)
                    low, high = (np.searchsorted(ranked, level[mine], side) for side in ("left", "right"))
                    n[mine] += len(ranked) - high
                    for i in mine[high > low]:
                        same = tile.column(0).filter(pa.array(column == level[i]))
                        n[i] += pc.sum(pc.less(same, docs[i])).as_py() or 0
            at = np.flatnonzero(n)
            g = np.zeros(len(level), np.int64)
            g[order] = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, object)[g[at] // n_q], pa.string()), pa.array(ids.value, own).take(pa.array(g[at] % n_q)), docs.take(pa.array(at)), pa.array(n[at])], names=["leg", "query_id", "doc_id", "n"])

        per = self.rows.select("doc_id", "terms").mapInArrow(run, f"leg string, query_id {self.kind}, doc_id {self.doc_kind}, n long")
        return per.groupBy("leg", "query_id", "doc_id").agg(F.sum("n").alias("n"))

    def sums(self) -> DataFrame:
        """(query_id, leg, n, s, s2): the number of matches, their sum and sum of squares, of queries with a match."""
        shared, spark = self._shared(), prepare(self.rows.sparkSession)
        names, n_q = list(self.legs), len(self.queries)
        ids = spark.sparkContext.broadcast(self.queries)
        kind = pa.string() if self.kind == "string" else None

        def run(batches):
            out = np.zeros((3, len(names), n_q))
            for tile in tiles(batches, max(1, CELLS // max(1, n_q))):
                s, m = Scan._tile(shared.value, tile)
                out += np.stack([m.sum(1), s.sum(1), (s * s).sum(1)])
            leg, q = np.nonzero(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(ids.value, kind).take(pa.array(q)), pa.array(np.array(names, object)[leg], pa.string()), pa.array(out[0][leg, q].astype(np.int64)), pa.array(out[1][leg, q]), pa.array(out[2][leg, q])], names=["query_id", "leg", "n", "s", "s2"])

        per = self.rows.select("doc_id", "terms").mapInArrow(run, f"query_id {self.kind}, leg string, n long, s double, s2 double")
        return per.groupBy("query_id", "leg").agg(*(F.sum(c).alias(c) for c in ("n", "s", "s2")))
