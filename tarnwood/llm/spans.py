"""Substring dedup by sliding sentence spans and passages of words.

A text is cut into units: sentences, and pieces of 16 words of longer ones.
Every run of three consecutive units, or of as many more as hold ten words, is
hashed. Beside the runs, whose places depend on where sentences begin, hashes of
35 words at any place are winnowed: in every 16 that follow one another the
least is chosen, by content alone, so any 50 words that occur twice, whatever
their place in a sentence, have a chosen hash in common. All hashes are joined
over the whole corpus, and the words that any but the first occurrence of a hash
covers are removed; of a passage of over 50 words at most 15 stay at either end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .parity_join import id_filter, may_hold
from .runtime import Scratch, prepare

RUN, UNIT_WORDS, LEAST_WORDS = 3, 16, 10
#: Words of a hashed passage, and hashes of which the least is chosen: 35 + 16 - 1 = 50 words are always met.
PASSAGE, CHOICE = 35, 16
#: A hit is its first word times this plus its words, of which there are fewer.
HIT = 64
U = np.uint64


def _cuts(column, longest: int = UNIT_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, first, start, hash, at): the words of a column, and those at which a unit begins."""
    buf, off, starts, ends, first, h = tv.words(column)
    n = len(starts)
    if not n:
        return off, np.zeros(len(off), np.int64), starts, h, starts
    nxt = np.full(len(buf), 10, np.uint8)
    nxt[:-1] = buf[1:]
    nxt[off[1:][off[1:] > 0] - 1] = 10
    stop = (buf == 10) | (((buf == 46) | (buf == 33) | (buf == 63)) & (tv.CLASS[nxt] == 0))
    seen = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(stop, out=seen[1:])
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = seen[starts[1:]] != seen[ends[:-1]]
    new[first[:-1][np.diff(first) > 0]] = True
    head = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(head, np.diff(np.r_[head, n]))
    return off, first, starts, h, np.flatnonzero(new | (place % longest == 0))


def _sums(h: np.ndarray, at: np.ndarray, longest: int = UNIT_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(words, hash) of the units that begin at these words."""
    if not len(h):
        return at, h
    count = np.diff(np.r_[at, len(h)])
    inside = np.arange(len(h)) - np.repeat(at, count)
    power = np.multiply.accumulate(np.r_[U(1), np.full(longest, 0xD6E8FEB86659FD93, U)])
    return count, tv.mix(np.add.reduceat(h * power[inside], at) + count.astype(U))


def units(column, longest: int = UNIT_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, first, start, words, hash) of the units of a column; start is the byte at which a unit's first word begins.

    A sentence ends at a line break, or at . ! or ? before white space or the end.
    """
    off, first, starts, h, at = _cuts(column, longest)
    return off, np.searchsorted(at, first), starts[at], *_sums(h, at, longest)


def span_hashes(h: np.ndarray, count: np.ndarray, first: np.ndarray, run: int = RUN, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, units, hash) of each run of ``run`` units, or of as many more as hold enough words."""
    n = len(h)
    if n < run:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), h[:0]
    doc = tv.doc_of(first)
    words = np.r_[0, np.cumsum(count)]
    at = np.arange(n)
    size = np.maximum(run, np.searchsorted(words, words[:-1] + least) - at)
    good = at + size <= first[doc + 1]
    at, size = at[good], size[good]
    g = np.zeros(len(at), U)
    for k in range(int(size.max(initial=0))):
        more = size > k
        g[more] = tv.mix(g[more] * U(5) + h[at[more] + k])
    return doc[at], at - first[doc[at]], size, g


def _slide(x: np.ndarray, wide: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of every ``wide`` values that follow one another."""
    done = 1
    while done < wide:
        step = min(done, wide - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def passages(h: np.ndarray, first: np.ndarray, words: int = PASSAGE, choice: int = CHOICE) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the passages that winnowing chooses: all that are the least of ``choice`` neighbours of their document."""
    n = len(h)
    m = n - words + 1
    if m < choice:
        return np.empty(0, np.int64), h[:0]
    power, inverse = tv._powers(n + 1)
    sums = np.r_[U(0), np.cumsum(h * power[:n])]
    g = tv.mix((sums[words:] - sums[:m]) * inverse[:m]) | U(1)
    doc = tv.doc_of(first)
    low = _slide(g, choice, np.minimum)
    # neighbours that reach over the end of a document choose nothing
    low[doc[: len(low)] != doc[words + choice - 2 :]] = 0
    edge = np.zeros(choice - 1, U)
    at = np.flatnonzero(_slide(np.r_[edge, low, edge], choice, np.maximum) == g)
    return at, g[at]


def hits_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hit, hash) of the runs and the chosen passages of a column."""
    _, first, _, words, at = _cuts(column)
    count, h = _sums(words, at)
    unit_first = np.searchsorted(at, first)
    doc, pos, size, g = span_hashes(h, count, unit_first)
    run = unit_first[doc] + pos
    ends = np.r_[at, len(words)]
    place, p = passages(words, first)
    start, length = np.r_[at[run], place], np.r_[ends[run + size] - at[run], np.full(len(place), PASSAGE)]
    doc = np.r_[doc, tv.doc_of(first)[place]]
    return doc, (start - first[doc]) * HIT + length, np.r_[g, p]


def _spans(key: str):
    """(key, hit, h, again) of each hit; again is whether the same row has the hash at a place before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in tv.slices(whole):
                doc, hit, g = hits_of(b.column("text"))
                order = np.lexsort((hit, g, doc))
                doc, hit, g = doc[order], hit[order], g[order]
                again = np.zeros(len(g), bool)
                again[1:] = (g[1:] == g[:-1]) & (doc[1:] == doc[:-1])
                ids = b.column(key).cast(pa.int64()).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(hit), pa.array(g.view(np.int64)), pa.array(again)], names=["key", "hit", "h", "again"])

    return run


def cut(texts: list[str], hits: list) -> list[tuple[str, int]]:
    """The texts without the words that the given hits cover, and the number of units that lose any."""
    column = pa.array(texts, pa.large_string())
    off, first, start, _, at = _cuts(column)
    raw = tv.bytes_of(column)[0].tobytes()
    out = []
    for d, hit in enumerate(hits):
        a, b, lo, hi = first[d], first[d + 1], off[d], off[d + 1]
        gone = np.zeros(b - a + 1, np.int64)
        hit = np.asarray(hit, np.int64)
        np.add.at(gone, hit // HIT, 1)
        np.add.at(gone, hit // HIT + hit % HIT, -1)
        covered = np.cumsum(gone)[:-1] > 0
        own = at[np.searchsorted(at, a) : np.searchsorted(at, b)] - a
        count = int(np.logical_or.reduceat(covered, own).sum()) if len(own) else 0
        turn = np.flatnonzero(np.r_[True, covered[1:] != covered[:-1]]) if b > a else np.empty(0, np.int64)
        edges = np.r_[lo, start[a + turn[1:]], hi]
        stay = ~covered[turn] if b > a else np.ones(1, bool)
        kept = b"".join(raw[edges[i] : edges[i + 1]] for i in np.flatnonzero(stay))
        out.append((kept.decode("utf-8", "replace").rstrip(), count))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hits = b.column("__hits").to_pylist()
        found = [i for i, x in enumerate(hits) if x]
        names = [n for n in b.schema.names if n != "__hits"]
        columns = {n: b.column(n) for n in names}
        gone = np.zeros(len(hits), np.int32)
        if found:
            text = columns["text"].to_pylist()
            done = cut([text[i] or "" for i in found], [hits[i] for i in found])
            for i, (t, k) in zip(found, done):
                text[i], gone[i] = t, k
            columns["text"] = pa.array(text, pa.string())
        yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(gone)], names=[*names, "__removed"])
        tv.trim()


def repeated_spans(docs: DataFrame, scratch: Scratch, key: str = "doc_id") -> DataFrame:
    """(key, hits): the words that non-first occurrences of runs and passages cover, for the rows that have any.

    ``key`` is unique and never null. First is the occurrence with the least
    (key, position). The first row of each hash comes from an aggregate, which
    combines before it shuffles, and is joined to the occurrences: a hash that
    a third of all texts holds is no group in one task, since a join's long
    partitions are split.
    """
    spans = scratch.keep(docs.select(key, "text").mapInArrow(_spans(key), "key long, hit long, h long, again boolean"), "spans")
    firsts = spans.groupBy("h").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1").select("h", "least")
    later = spans.join(scratch.keep(firsts, "firsts").hint("merge"), "h").where("again or key > least")
    return later.groupBy("key").agg(F.collect_set("hit").alias("hits"))


def drop_repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, removed): every document with the repeated words taken out, and how many units lost any.

    All rows come back, also those whose text becomes empty. A null or empty
    text, or one of fewer than three units and 50 words, stays as it is; a run
    of units that ends with the text before it has ten words is not compared. Rows with a null doc_id stay as they are.
    A text of any length is worked on whole. Rows that repeat a doc_id are
    documents of their own: of equal rows one stays whole, and of unlike ones
    that with the lesser hash of its text comes first. Repeats within one text
    count, and of those the first place stays. Other columns, whatever their
    names, are not read; an empty table gives no rows.
    """
    return without_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).withColumnRenamed("__removed", "removed")


def _part(wanted, inside: bool, key: str):
    """The rows that the bitmap of keys may hold, or the others, to which nothing is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(may_hold(wanted.value, b.column(key)) == inside))
            tv.trim()
            yield b if inside else pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros(b.num_rows, np.int32))], names=[*b.schema.names, "__removed"])

    return run


def keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """The rows and the name of a column that tells them apart, in the order in which occurrences count.

    That is doc_id where no two rows share one. Else the rows are written once,
    sorted by doc_id and the text's hash, with a number as a new column; equal rows
    are spread over the tasks of the sort by a random number.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    if not ids.where("n > 1").limit(1).count():
        return docs, "doc_id"
    key = "__key"
    while key in docs.columns:
        key += "_"
    number = F.monotonically_increasing_id()
    rows = docs.orderBy("doc_id", F.xxhash64("text"), F.rand(7)).withColumn(key, F.when(F.col("doc_id").isNotNull(), number))
    return scratch.keep(rows, "rows"), key


def without_spans(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns kept, with the repeated words taken out of ``text``, and the number of units that lose any as ``__removed``.

    Nulls, repeated rows, long, short and empty texts are treated as
    ``drop_repeated_spans`` says. A bitmap of the keys with hits keeps all other
    texts out of the join; where there are too many keys for it, all texts are
    joined.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "spans")
    rows, key = keyed(docs, scratch)
    hits = scratch.keep(repeated_spans(rows.where(F.col(key).isNotNull()), scratch, key), "hits")
    wanted = spark.sparkContext.broadcast(id_filter(hits.select("key")))
    hits = hits.select(F.col("key").alias("__id"), F.col("hits").alias("__hits"))
    out = T.StructType([*rows.schema.fields, T.StructField("__removed", T.IntegerType())])
    touched = rows.mapInArrow(_part(wanted, True, key), rows.schema)
    # both sides grow with the input; and the shuffle between the two Python steps keeps a task at one worker
    joined = touched.join(hits.hint("merge"), touched[key] == F.col("__id"), "left").drop("__id")
    done = rows.mapInArrow(_part(wanted, False, key), out).union(joined.mapInArrow(_cut, out))
    return done.select(*docs.columns, "__removed")
