"""Dictionary matching: all patterns at once over each text, with byte offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwood.session import prepare

from . import lexindex as lx

MOST_PATTERNS = 2_000_000
_WORD = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_") | frozenset(range(128, 256))


def compile_patterns(patterns: list[tuple[int, str, int | None]], fold: bool = True):
    """The automaton of (pattern_id, pattern, type_id); of equal patterns the least id counts."""
    import ahocorasick

    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} patterns")
    own = ahocorasick.Automaton()
    for pid, p, kind in sorted(patterns, reverse=True, key=lambda x: x[0]):
        raw = p.encode()
        if not raw:
            raise ValueError("an empty pattern")
        raw = raw.lower() if fold else raw
        own.add_word(raw.decode("latin-1"), (pid, len(raw), kind))
    if len(own):
        own.make_automaton()
    return own


def match(own, text: str, fold: bool = True, whole_word: bool = True, longest: bool = True) -> list[tuple[int, int, int, int | None]]:
    """(pattern_id, begin, end, type_id): the leftmost-longest hits that don't overlap, or all hits."""
    if not len(own):
        return []
    raw = text.encode()
    hits = []
    for last, (pid, size, kind) in own.iter((raw.lower() if fold else raw).decode("latin-1")):
        a, b = last + 1 - size, last + 1
        if whole_word and ((a and raw[a - 1] in _WORD and raw[a] in _WORD) or (b < len(raw) and raw[b] in _WORD and raw[b - 1] in _WORD)):
            continue
        hits.append((pid, a, b, kind))
    hits.sort(key=lambda h: (h[1], -h[2], h[0]))
    if not longest:
        return hits
    out, end = [], 0
    for h in hits:
        if h[1] >= end:
            out.append(h)
            end = h[2]
    return out


def match_docs(docs: DataFrame, patterns: DataFrame, fold: bool = True, whole_word: bool = True, longest: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pattern_id, begin, end, type_id) of ``patterns(pattern_id, pattern[, type_id])``; the patterns are counted before they are shared, and the automaton is built once a task."""
    spark = prepare(docs.sparkSession)
    kind = F.col("type_id").cast("int") if "type_id" in patterns.columns else F.lit(None).cast("int")
    rows = patterns.select(F.col("pattern_id").cast("long"), F.col("pattern").cast("string"), kind).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} patterns")
    shared = spark.sparkContext.broadcast([tuple(r) for r in rows if r[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compile_patterns(shared.value, fold)
        for b in batches:
            ids, found = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hits = match(own, t or "", fold, whole_word, longest)
                ids += [k] * len(hits)
                found += hits
            cols = list(zip(*found)) if found else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=[key, "pattern_id", "begin", "end", "type_id"])

    key_kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {key_kind}, pattern_id long, begin int, end int, type_id int")


def word_dictionary(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, pattern_id, n): how often patterns of whole words occur, overlaps included, for dictionaries too large to share.

    Places are found by an equi-join on a pattern's first two words (or its
    only one), and only there the words that follow are compared.
    """
    from tarnwood.functions import text as T

    rows = lx.words(docs)
    sized = patterns.select("pattern_id", T.terms("pattern").alias("p")).where(F.size("p") > 0).withColumn("lead", F.concat_ws(" ", F.slice("p", 1, 2)))
    long_, short = sized.where("size(p) > 1"), sized.where("size(p) = 1")
    one = rows.select("doc_id", F.posexplode("terms").alias("pos", "lead"))
    two = rows.select("doc_id", F.posexplode(T.ordered_bigrams(F.col("terms"))).alias("pos", "lead"))
    whole = one.join(short.select("lead", "pattern_id"), "lead").select("doc_id", "pattern_id")
    begun = two.join(long_.select("lead", "pattern_id"), "lead").select("doc_id", "pos", "pattern_id")
    met = begun.join(long_.select("pattern_id", "p"), "pattern_id").join(rows, "doc_id").where(F.slice("terms", F.col("pos") + 1, F.size("p")) == F.col("p"))
    return whole.unionByName(met.select("doc_id", "pattern_id")).groupBy("doc_id", "pattern_id").agg(F.count("*").alias("n"))
