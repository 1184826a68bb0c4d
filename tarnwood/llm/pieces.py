"""SentencePiece encoding with N-best segmentations, and decoding.

The pieces of a vocabulary file span a lattice over a text. Forward Viterbi
scores, the best score of any path from the start to each place, are exact
heuristics for an A* search that runs backward from the end, so it yields
segmentations from the best down and expands no place in vain.

No piece goes on after a space that follows another sign, so the lattice falls
apart at the beginnings of words. Viterbi runs once for each distinct word of a
slice, for all words at once; the search runs inside the few words in which the
document's next best segmentations can differ, and once more over the choices
among these words.

A piece's score is log(1 / (r + 2) / Z), with r the rank of the piece in the
vocabulary and Z so that all add up to 1.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import prepare

MODEL, NBEST = "/opt/tokenizers/piece_bpe_32k.model", 4
U = np.uint64
_SLOTS = 20


@dataclass
class Vocabulary:
    """Pieces as bytes, with a space for the sign that marks one."""

    pieces: list[bytes]
    score: np.ndarray
    byte_id: np.ndarray
    ids: dict[bytes, int]
    longest: int
    keys: np.ndarray
    values: np.ndarray
    #: Neighbouring characters inside pieces, as sorted numbers: between others no piece reaches.
    pairs: np.ndarray
    memo: dict = field(default_factory=dict)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The id of each hash's piece, or -1."""
        slot = (h >> U(64 - _SLOTS)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        while len(todo):
            got = self.values[slot[todo]]
            same = (self.keys[slot[todo]] == h[todo]) & (got >= 0)
            out[todo[same]] = got[same]
            todo = todo[~same & (got >= 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << _SLOTS) - 1)
        return out


def make_vocabulary(pieces: list[bytes], score: np.ndarray, byte_id: np.ndarray) -> Vocabulary:
    usable = {p: i for i, p in enumerate(pieces) if p and np.isfinite(score[i]) and i not in set(byte_id.tolist())}
    if any(b" " in p.lstrip(b" ") for p in usable):
        raise ValueError("a piece goes on after an inner space")
    keys, values = np.zeros(1 << _SLOTS, U), np.full(1 << _SLOTS, -1, np.int32)
    flat = np.frombuffer(b"".join(usable), np.uint8)
    ends = np.cumsum([len(p) for p in usable])
    for h, i in zip(tv.hashes(flat, np.r_[0, ends[:-1]], ends).tolist(), usable.values()):
        s = h >> (64 - _SLOTS)
        while values[s] >= 0:
            s = (s + 1) & ((1 << _SLOTS) - 1)
        keys[s], values[s] = h, i
    chars = (p.decode("utf-8", "surrogatepass") for p in usable if len(p) > 1)
    pairs = np.array(sorted({ord(a) << 21 | ord(b) for c in chars for a, b in zip(c, c[1:])}), np.int64)
    return Vocabulary(pieces, score, byte_id, usable, max(map(len, usable)), keys, values, pairs)


def piece_scores(raw: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Log-probabilities of the pieces that are ``live``: a unigram model's own scores, or those of ranks where the scores are minus the ranks of merges."""
    out = np.full(len(raw), -np.inf)
    if (raw[live] == np.round(raw[live])).all():
        out[live] = -np.log(2 - raw[live]) - np.log(np.sum(1 / (2 - raw[live])))
    else:
        out[live] = raw[live]
    return out


@functools.lru_cache(2)
def vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, byte_id = [b""] * n, np.full(256, -1)
    for i in range(n):
        if sp.is_byte(i):
            byte_id[int(sp.id_to_piece(i)[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[i] = sp.id_to_piece(i).replace("▁", " ").encode()
    if (byte_id < 0).any():
        raise ValueError("the model doesn't spell unknown characters in bytes")
    live = np.array([bool(p) for p in pieces])
    score = piece_scores(np.array([sp.get_score(i) for i in range(n)]), live)
    score[byte_id] = score[live].min() - 1
    for b in range(256):
        pieces[byte_id[b]] = bytes([b])
    return make_vocabulary(pieces, score, byte_id)


def fallback(voc: Vocabulary, buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to characters that are no piece; only these may be spelt in bytes. The buffer begins with a character."""
    bad = np.array([bytes([b]) not in voc.ids for b in range(256)])[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        size = np.where(buf[lead] >= 0xF0, 4, np.where(buf[lead] >= 0xE0, 3, 2))
        known = voc.find(tv.hashes(buf, lead, lead + size)) >= 0
        lead, size = lead[known], size[known]
        bad[np.repeat(lead - (np.cumsum(size) - size), size) + np.arange(size.sum())] = False
    return bad


def segment(voc: Vocabulary, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For words as byte ranges: the best ids of each, their scores, and how much worse the second best is (inf: there is none)."""
    n = len(starts)
    ids: list = [None] * n
    best, gap = np.zeros(n), np.full(n, np.inf)
    if not n:
        return ids, best, gap
    spell = fallback(voc, buf)
    power, inverse = tv._powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * power[: len(buf)], out=sums[1:])
    length = ends - starts
    for width in np.unique(np.ceil(np.log2(np.maximum(length, 1))).astype(int)):
        group = np.flatnonzero(np.ceil(np.log2(np.maximum(length, 1))).astype(int) == width)
        group = group[np.argsort(-length[group], kind="stable")]
        size, at = length[group], starts[group]
        top, m = int(size[0]), len(group)
        alive = np.searchsorted(-size, -np.arange(top + 2), side="right")  # words at least so long

        def arcs(j: int):
            """(piece length, words, ids, scores) of the pieces that end at j."""
            k = alive[j]
            for ell in range(1, min(j, voc.longest) + 1):
                a = at[:k] + (j - ell)
                found = voc.find(tv.mix((sums[a + ell] - sums[a]) * inverse[a] + U(ell)))
                if ell == 1:
                    raw = (found < 0) & spell[a]
                    found = np.where(raw, voc.byte_id[buf[a]], found)
                w = np.flatnonzero(found >= 0)
                if len(w):
                    yield ell, w, found[w], voc.score[found[w]]

        forward = np.full((m, top + 1), -np.inf)
        forward[:, 0] = 0
        back = np.zeros((m, top + 1), np.int32)
        piece = np.full((m, top + 1), -1, np.int32)
        kept = {}
        keep_arcs = m * top < 4_000_000
        for j in range(1, top + 1):
            here = []
            for ell, w, i, s in arcs(j):
                v = forward[w, j - ell] + s
                here.append((ell, w, s))
                better = v > forward[w, j]
                b = w[better]
                forward[b, j], back[b, j], piece[b, j] = v[better], ell, i[better]
            if keep_arcs:
                kept[j] = here
        best[group] = forward[np.arange(m), size]
        on = np.zeros((m, top + 1), bool)
        pos, live = size.copy(), np.arange(m)
        trail, count_ = np.full((m, top), -1, np.int32), np.zeros(m, np.int64)
        while len(live):
            p = pos[live]
            on[live, p] = True
            trail[live, count_[live]] = piece[live, p]
            count_[live] += 1
            pos[live] = p - back[live, p]
            live = live[pos[live] > 0]
        for row, g in enumerate(group.tolist()):
            ids[g] = trail[row, : count_[row]][::-1]
        backward = np.full((m, top + 1), -np.inf)
        backward[np.arange(m), size] = 0
        worse = np.full(m, np.inf)
        total = best[group]
        for j in range(top, 0, -1):
            for ell, w, s in kept.pop(j) if keep_arcs else ((e, x, z) for e, x, _, z in arcs(j)):
                rest = s + backward[w, j]
                off = ~(on[w, j] & (back[w, j] == ell))
                x = w[off]
                worse[x] = np.minimum(worse[x], total[x] - (forward[x, j - ell] + rest[off]))
                backward[w, j - ell] = np.maximum(backward[w, j - ell], rest)
        gap[group] = np.maximum(worse, 0)
    return ids, best, gap


def nbest_word(voc: Vocabulary, word: bytes, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a word with their scores, best first: Viterbi forward, A* backward."""
    chars, i = set(), 0
    for ch in word.decode("utf-8", "surrogateescape"):
        raw = ch.encode("utf-8", "surrogateescape")
        if raw not in voc.ids:
            chars.update(range(i, i + len(raw)))
        i += len(raw)
    size = len(word)
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
    forward = [0.0] + [-np.inf] * size
    for j in range(1, size + 1):
        for i in range(max(0, j - voc.longest), j):
            k = voc.ids.get(word[i:j])
            if k is None and j - i == 1 and i in chars:
                k = int(voc.byte_id[word[i]])
            if k is not None and forward[i] > -np.inf:
                s = float(voc.score[k])
                into[j].append((i, k, s))
                forward[j] = max(forward[j], forward[i] + s)
    # of paths with equal scores the one nearest to the start goes on, else a run of one sign, with its countless equals, would never end
    order, found = count(), []
    heap = [(round(-forward[size], 6), size, next(order), 0.0, None)]
    while heap and len(found) < n:
        _, j, _, g, path = heapq.heappop(heap)
        if j == 0:
            ids = []
            while path:
                ids.append(path[0])
                path = path[1]
            found.append((g, ids))
            continue
        for i, k, s in into[j]:
            heapq.heappush(heap, (round(-(forward[i] + s + g), 6), i, next(order), s + g, (k, path)))
    return sorted(found, key=lambda x: -x[0])


def choices(options: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n least sums of one loss from each list (each list rises from 0), with the indices taken."""
    start = (0,) * len(options)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) < n:
        loss, pick = heapq.heappop(heap)
        out.append((loss, pick))
        for w, i in enumerate(pick):
            if i + 1 < len(options[w]):
                nxt = (*pick[:w], i + 1, *pick[w + 1 :])
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (loss - options[w][i] + options[w][i + 1], nxt))
    return out


#: Words of more bytes are cut wherever no piece can reach over.
LONG_WORD = 64


def code_points(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The characters that begin at these bytes."""
    more = [buf[np.minimum(at + k, len(buf) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
    lead = buf[at].astype(np.int64)
    two, three, four = (lead & 0x1F) << 6 | more[0], (lead & 0x0F) << 12 | more[0] << 6 | more[1], (lead & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]
    return np.select([lead < 0x80, lead < 0xE0, lead < 0xF0], [lead, two, three], four)


def split_words(texts: list[str | None], pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, first) of the words of texts, each text with a space before it; a word begins where a space follows another sign, and at and after a line break.

    With ``pairs``, the characters that can be neighbours in a piece, long words
    are cut between all others. No segmentation is lost by that, and text
    without spaces falls into short words.
    """
    raw = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=off[1:])
    n = len(buf)
    if not n:
        return buf, off[:0], off[:0], np.zeros(len(off), np.int64)
    new = np.zeros(n, bool)
    new[1:] = ((buf[1:] == 32) & (buf[:-1] != 32)) | (buf[1:] == 10) | (buf[:-1] == 10)
    new[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(new)
    if pairs is not None:
        size = np.diff(np.r_[starts, n])
        at = np.flatnonzero(np.repeat(size > LONG_WORD, size) & ((buf & 0xC0) != 0x80))
        if len(at) > 1:
            point = code_points(buf, at)
            new[at[1:][~np.isin(point[:-1] << 21 | point[1:], pairs)]] = True
            starts = np.flatnonzero(new)
    return buf, starts, np.r_[starts[1:], n], np.searchsorted(starts, off)


def encode_texts(voc: Vocabulary, texts: list[str | None], n: int = NBEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(ids, first, score, others) of texts: others are the 2nd to n-th best as (score, [(place in ids, ids left out, ids put in)])."""
    buf, starts, ends, first = split_words(texts, voc.pairs)
    h = tv.hashes(buf, starts, ends)
    _, at, which = np.unique(h, return_index=True, return_inverse=True)
    width = ends[at] - starts[at]
    stop = np.cumsum(width)
    ids, best, gap = segment(voc, buf[np.repeat(starts[at] - (stop - width), width) + np.arange(width.sum())], stop - width, stop)
    size = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if len(ids) else np.empty(0, np.int32)
    head = np.cumsum(size) - size
    per = size[which] if len(which) else size[:0]
    place = np.cumsum(per) - per
    out = flat[np.repeat(head[which] - place, per) + np.arange(per.sum())] if len(which) else flat
    edges = np.r_[place, per.sum()][first]
    scores, others = np.zeros(len(texts)), []
    word_gap = gap[which] if len(which) else gap
    word_best = best[which] if len(which) else best
    for d in range(len(texts)):
        a, b = int(first[d]), int(first[d + 1])
        more = []
        if b > a:
            scores[d] = word_best[a:b].sum()
            g = word_gap[a:b]
            near = np.argpartition(g, n - 1)[:n] if b - a > n else np.arange(b - a)
            near = sorted((w for w in near.tolist() if np.isfinite(g[w])), key=lambda w: (g[w], w))[: n - 1]
            alternatives = []
            for w in near:
                word = buf[starts[a + w] : ends[a + w]].tobytes()
                if (word, n) not in voc.memo:
                    if len(voc.memo) > 200_000:
                        voc.memo.clear()
                    voc.memo[word, n] = nbest_word(voc, word, n)
                alternatives.append(voc.memo[word, n])
            losses = [[x[0][0] - s for s, _ in x] for x in alternatives]
            base = [out[place[a + w] : place[a + w] + per[a + w]].tolist() for w in near]
            ranked = [[i for i in range(len(x)) if x[i][1] != b_] for x, b_ in zip(alternatives, base)]
            # the best of Viterbi takes the first place, whichever of equals the search found first
            ordered = [[b_, *(x[i][1] for i in r)] for x, b_, r in zip(alternatives, base, ranked)]
            losses = [sorted(l)[: len(o)] for l, o in zip(losses, ordered)]
            for loss, pick in choices(losses, n)[1:]:
                edits = [(int(place[a + w] - edges[d]), int(per[a + w]), o[i]) for w, o, i in zip(near, ordered, pick) if i]
                more.append((scores[d] - loss, edits))
        others.append(more)
    return out, edges, scores, others


def decode_ids(voc: Vocabulary, ids) -> str:
    """The text of a list of ids, without the space that encoding put before it."""
    return b"".join(voc.pieces[int(i)] for i in ids)[1:].decode("utf-8", "replace")


def apply_edits(ids: list[int], edits) -> list[int]:
    """The ids of another segmentation: the best one's with (at, drop, ids) put in."""
    out = list(ids)
    for at, drop, new in sorted(edits, key=lambda e: -e[0]):
        out[at : at + drop] = new
    return out


_EDIT = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
_OTHER = pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))])
SCHEMA = "doc_id long, score double, ids array<int>, others array<struct<score:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>"


def _encode(path: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for whole in batches:
            for b in tv.slices(whole, "text", 2 << 20):
                ids, first, score, others = encode_texts(voc, b.column("text").to_pylist(), n)
                rows = [[{"score": s, "edits": [{"at": a, "drop": k, "ids": x} for a, k, x in e]} for s, e in more] for more in others]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(score), tv.lists(ids, first, pa.int32()), pa.array(rows, pa.list_(_OTHER))], names=["doc_id", "score", "ids", "others"])

    return run


def encode(docs: DataFrame, path: str = MODEL, n: int = NBEST) -> DataFrame:
    """(doc_id, score, ids, others): the best segmentation of each text and, as edits of it, the next ones up to the n-th.

    ``apply_edits`` turns an edit into the ids of that segmentation; fewer are
    given where a text has fewer. Characters that are no piece are spelt in
    bytes. A text of any length is encoded whole; the work on a run without
    spaces grows with its pieces. Equal scores keep any order. A null or empty text has no ids, score 0
    and no others; a null doc_id stays null; rows that repeat are encoded one by
    one. Other columns, whatever their names, are not read; an empty table gives
    no rows. No shuffle takes place.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(path, n), SCHEMA)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for b in batches:
            text = [None if x is None else decode_ids(voc, x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows with ``ids``; null ids give null, no ids give ''."""
    prepare(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")
