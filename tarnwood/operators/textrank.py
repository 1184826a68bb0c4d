"""TextRank over all sentences of each document: one Arrow stage, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwood.session import prepare

_END = re.compile(r"[.!?]+|\n\n")
_TOKEN = re.compile(rb"[0-9A-Za-z_'\-\x80-\xff]+")
_TRIM = "".join(map(chr, range(33)))


#: Texts of more sentences are scored without a matrix of their pairs.
MOST_DENSE = 256


def split(text: str) -> list[str]:
    return [part for part in (p.strip(_TRIM) for p in _END.split(text)) if part]


def tokens(sentence: str) -> list[bytes]:
    """The distinct ASCII-folded tokens of two bytes or more."""
    return list(dict.fromkeys(t for t in _TOKEN.findall(sentence.encode().lower()) if len(t) >= 2))


def scores(sets: list[list[bytes]], damping: float = 0.85, iters: int = 30, close: float = 1e-4) -> np.ndarray:
    """The stationary scores of sentences linked by shared tokens, over the log of their sizes."""
    n = len(sets)
    if n == 1:
        return np.ones(1)
    move = _dense(sets) if n <= MOST_DENSE else _sparse(sets)
    s = np.full(n, 1.0)
    for _ in range(iters):
        new = (1 - damping) + damping * move(s)
        far = np.abs(new - s).sum()
        s = new
        if far < close:
            break
    return s


def _dense(sets: list[list[bytes]]):
    """A step along the links of all pairs of sentences."""
    n = len(sets)
    names: dict[bytes, int] = {}
    x = np.zeros((n, len({t for s in sets for t in s})))
    for i, s in enumerate(sets):
        for t in s:
            x[i, names.setdefault(t, len(names))] = 1
    logs = np.log(x.sum(1) + 1)
    w = (x @ x.T) / (logs[:, None] + logs[None])
    np.fill_diagonal(w, 0)
    total = w.sum(1)
    move = np.divide(w, total[:, None], out=np.zeros_like(w), where=total[:, None] > 0)
    return lambda s: s @ move


def _sparse(sets: list[list[bytes]]):
    """The same step by tokens: sentences of one size have one log, so they add up token by token before they meet the others. Memory grows with the tokens, not with the pairs."""
    n, names = len(sets), {}
    i = np.repeat(np.arange(n), [len(s) for s in sets])
    t = np.array([names.setdefault(x, len(names)) for s in sets for x in s])
    size = np.bincount(i, minlength=n)
    logs = np.log(size + 1.0)
    kinds = [(logs[own[0]], own, np.flatnonzero(np.isin(i, own))) for own in (np.flatnonzero(size == z) for z in np.unique(size))]
    itself = size / (2 * logs)

    def spread(g: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for log, _, at in kinds:
            per = np.bincount(t[at], g[i[at]], len(names))
            out += np.bincount(i, per[t], n) / (log + logs)
        return out - g * itself

    total = spread(np.ones(n))
    # the least link is far above what rounding leaves of none
    share = np.divide(1.0, total, out=np.zeros(n), where=total > 1e-9)
    return lambda s: spread(s * share)


def rank(text: str | None, top: int | None = None, least_tokens: int = 3) -> list[tuple[int, str, float]]:
    """(index, sentence, score) by falling score, equal ones in order; sentences of fewer than three tokens are left out."""
    found = [(i, s, t) for i, s in enumerate(split(text or "")) if len(t := tokens(s)) >= least_tokens]
    if not found:
        return []
    s = scores([t for *_, t in found])
    order = np.argsort(-np.round(s, 9), kind="stable")[:top]
    return [(found[i][0], found[i][1], float(s[i])) for i in order]


def rank_docs(docs: DataFrame, top: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, idx, sentence, score): each document's sentences by score, the best at place 1."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            out: list[list] = [[], [], [], [], []]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for place, (i, s, score) in enumerate(rank(t, top), 1):
                    for column, v in zip(out, (k, place, i, s, score)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()), pa.array(out[4], pa.float64())], names=[key, "place", "idx", "sentence", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, place int, idx int, sentence string, score double")


def top_sentence(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, sentence): the best sentence of each document."""
    return rank_docs(docs, 1).select("doc_id", "idx", "sentence")


def lead_agreement(docs: DataFrame) -> DataFrame:
    """One row: the share of ranked documents whose best sentence is their first."""
    return rank_docs(docs, 1).agg(F.avg(F.when(F.col("idx") == 0, 1.0).otherwise(0.0)).alias("agreement"), F.count("*").alias("n"))
