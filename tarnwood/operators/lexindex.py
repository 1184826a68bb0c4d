"""The inverted index as relations: document lengths, postings, term and corpus statistics.

An index of any kind (words, character n-grams, bigrams, an auxiliary field)
comes from a frame ``(doc_id, terms)``. With ``wanted``, a frame of terms,
occurrences of other terms are dropped right after they are made, before
anything is shuffled; lengths and averages still cover all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwood.functions import text as T
from tarnwood.session import prepare

from . import pairs, scan

#: Of a term in df of n documents.
IDF = "ln((n - df + 0.5D) / (df + 0.5D) + 1D)"


@dataclass(frozen=True)
class LexIndex:
    """docs(doc_id, dl); postings(term, doc_id, dl, tf); stats(term, df, ttf, idf); corpus(n, total, avg_dl), one row."""

    docs: DataFrame
    postings: DataFrame
    stats: DataFrame
    corpus: DataFrame

    def save(self, path: str, buckets: int | None = None) -> None:
        """Write the relations as Parquet; postings are laid out by term, so that a query reads few row groups."""
        self.docs.write.parquet(f"{path}/docs")
        laid = self.postings.repartition(buckets, "term") if buckets else self.postings.repartition("term")
        laid.sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
        self.stats.sortWithinPartitions("term").write.parquet(f"{path}/stats")
        self.corpus.coalesce(1).write.parquet(f"{path}/corpus")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("docs", "postings", "stats", "corpus")))

    def lookup(self, terms: DataFrame, fold: bool = True) -> DataFrame:
        """Each term with df, ttf and idf; 0 where it isn't in the index."""
        keyed = terms.withColumn("__t", F.lower("term") if fold else F.col("term"))
        found = self.stats.withColumnRenamed("term", "__t")
        return keyed.join(found, "__t", "left").drop("__t").fillna(0, ["df", "ttf", "idf"])


def occurrences(rows: DataFrame, *names: str) -> DataFrame:
    """The named columns and ``term``, one row for each of ``terms``. The outer form is taken because the plain one has the terms made twice, once to see whether there are any."""
    return rows.select(*names, F.explode_outer("terms").alias("term")).where("term is not null")


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


def build(rows: DataFrame, wanted: DataFrame | None = None, max_df_ratio: float = 0.0) -> LexIndex:
    """The index of ``rows(doc_id, terms)``, or of those terms of it that are ``wanted(term)``.

    With ``max_df_ratio`` terms of more than that share of the documents are
    left out of postings and statistics, not of lengths.
    """
    sized = rows.select("doc_id", "terms", F.size("terms").cast("long").alias("dl"))
    docs = sized.select("doc_id", "dl")
    corpus = corpus_stats(docs)
    flat = occurrences(sized, "doc_id", "dl")
    if wanted is not None:
        flat = flat.join(wanted.select("term").distinct(), "term", "left_semi")
    postings = flat.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    stats = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf")).crossJoin(F.broadcast(corpus)).withColumn("idf", F.expr(IDF))
    if max_df_ratio:
        stats = stats.where(F.col("df") <= F.floor(F.lit(max_df_ratio) * F.col("n")))
        postings = postings.join(stats.select("term"), "term", "left_semi")
    return LexIndex(docs, postings, stats.select("term", "df", "ttf", "idf"), corpus)


def statistics(rows: DataFrame, bigrams: bool = False) -> DataFrame:
    """(term, df, ttf, idf): the statistics of ``build``, of all words, or of all neighbours 'a b'. Each batch of documents counts its own terms, so no posting is shuffled; where ids repeat, ``build`` does it."""
    if not scan.unique_ids(rows):
        return build(ordered(rows) if bigrams else rows).stats
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pairs.slices(whole, 2_000_000):
                terms = b.column("terms")
                flat = terms.flatten().dictionary_encode()
                key = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
                names = flat.dictionary
                if bigrams:
                    one, two, row = pairs.within(key, row, 1)
                    code, key = np.unique(one * max(1, len(names)) + two, return_inverse=True)
                    one, two = np.divmod(code, max(1, len(names)))
                    names = pc.binary_join_element_wise(names.take(pa.array(one)), names.take(pa.array(two)), " ")
                each, tf = np.unique(row * max(1, len(names)) + key, return_counts=True)
                key = each % max(1, len(names))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(key, minlength=len(names))), pa.array(np.bincount(key, tf, len(names)).astype(np.int64))], names=["term", "df", "ttf"])

    n = rows.agg(F.count("*").alias("n"))
    counts = rows.select("terms").mapInArrow(run, "term string, df long, ttf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"))
    return counts.crossJoin(F.broadcast(n)).select("term", "df", "ttf", F.expr(IDF).alias("idf"))


def tokenised(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their folded words as ``terms``, which every operator here takes instead of splitting the text again."""
    return docs.withColumn("terms", T.terms(text))


def words(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, terms): the folded words of each document; those of ``tokenised`` documents are there already."""
    if text == "text" and "terms" in docs.columns and docs.schema["terms"].dataType.simpleString() == "array<string>":
        return docs.select(F.col(key).alias("doc_id"), "terms")
    return docs.select(F.col(key).alias("doc_id"), T.terms(text).alias("terms"))


def derived(rows: DataFrame, make) -> DataFrame:
    """(doc_id, terms) with ``make`` applied to the words."""
    return rows.select("doc_id", make(F.col("terms")).alias("terms"))


def grams(rows: DataFrame, least: int = 3, most: int = 4) -> DataFrame:
    return derived(rows, lambda t: T.term_grams(t, least, most))


def ordered(rows: DataFrame) -> DataFrame:
    return derived(rows, T.ordered_bigrams)


def unordered(rows: DataFrame, window: int = 8) -> DataFrame:
    return derived(rows, lambda t: T.unordered_bigrams(t, window))


def gram_index(rows: DataFrame, wanted: DataFrame, least: int = 3, most: int = 4, max_df_ratio: float = 0.0) -> LexIndex:
    """The index of the character n-grams of all terms, for those n-grams that are ``wanted(term)``.

    Grams are made of each distinct term once, not of each occurrence, and met
    with the postings of words; lengths come from the terms' sizes.
    """
    size = lambda t: sum((F.greatest(F.length(t) - (k - 1), F.lit(0)) for k in range(least, most + 1)), F.lit(0))
    docs = rows.select("doc_id", F.aggregate("terms", F.lit(0).cast("long"), lambda acc, t: acc + size(t)).alias("dl"))
    flat = occurrences(rows, "doc_id").groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    parts = flat.select("term").distinct().select(F.col("term").alias("word"), F.explode(T.grams_of(F.col("term"), least, most)).alias("term"))
    parts = parts.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("word", "term").agg(F.count("*").alias("c"))
    tf = flat.withColumnRenamed("term", "word").join(parts, "word").groupBy("term", "doc_id").agg(F.sum(F.col("n") * F.col("c")).alias("tf"))
    return from_postings(docs, tf, max_df_ratio)


def from_postings(docs: DataFrame, tf: DataFrame, max_df_ratio: float = 0.0, corpus: DataFrame | None = None) -> LexIndex:
    """The index of counts ``tf(term, doc_id, tf)`` in ``docs(doc_id, dl)``."""
    corpus = corpus_stats(docs) if corpus is None else corpus
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf")).crossJoin(F.broadcast(corpus)).withColumn("idf", F.expr(IDF))
    if max_df_ratio:
        stats = stats.where(F.col("df") <= F.floor(F.lit(max_df_ratio) * F.col("n")))
        tf = tf.join(stats.select("term"), "term", "left_semi")
    sized = docs.groupBy("doc_id").agg(F.sum("dl").alias("dl"))
    return LexIndex(docs, tf.join(sized, "doc_id").select("term", "doc_id", "dl", "tf"), stats.select("term", "df", "ttf", "idf"), corpus)


def lead_field(docs: DataFrame, n: int = 64, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, terms) of the auxiliary field made of the first tokens."""
    return docs.select(F.col(key).alias("doc_id"), T.terms(T.lead_tokens(text, n)).alias("terms"))


def query_words(queries: DataFrame) -> DataFrame:
    """(query_id, terms): the folded words of each query."""
    return queries.select("query_id", T.terms("text").alias("terms"))


def query_terms(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """(query_id, term, qtf) of ``rows(query_id, terms)``: a repeated term counts as often as it occurs."""
    return occurrences(rows, "query_id").groupBy("query_id", "term").agg((F.count("*") if weight is None else F.sum(weight)).alias("qtf"))
