"""Streaming extensions: documents that arrive join the index, and windowed counts of events.

Document frequency, total frequency, number and lengths of documents are
additive, so a batch is aggregated by itself and appended as deltas; inverse
document frequency is derived when the deltas are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwood.operators import lexindex as lx


def append(batch: DataFrame, path: str, batch_id: int) -> None:
    """The index deltas of one batch, each in the folder of its batch, so that a repeated batch replaces itself."""
    part = lx.build(lx.words(batch.select("doc_id", "text")))
    for name, df in (("docs", part.docs), ("postings", part.postings), ("stats", part.stats.drop("idf"))):
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")


def index_stream(docs: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream of (doc_id, text) to the index at ``path``."""
    writer = docs.writeStream.foreachBatch(lambda df, k: append(df, path, k)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_index(spark: SparkSession, path: str) -> lx.LexIndex:
    """The index as of the batches so far."""
    docs, postings, deltas = (spark.read.parquet(f"{path}/{n}").drop("batch") for n in ("docs", "postings", "stats"))
    corpus = lx.corpus_stats(docs)
    stats = deltas.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf")).crossJoin(F.broadcast(corpus)).withColumn("idf", F.expr(lx.IDF))
    return lx.LexIndex(docs, postings, stats.select("term", "df", "ttf", "idf"), corpus)


def encode_stream(docs: DataFrame, **options) -> DataFrame:
    """Vectors of a stream of documents; encoding has no state."""
    from tarnwood.operators import embed

    return embed.encode(docs, **options)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type; with a stream, events over ``late`` behind are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")
