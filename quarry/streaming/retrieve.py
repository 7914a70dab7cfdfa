"""Retrieval over a stream of queries.

Queries arrive as a Structured Streaming source (files landing in a folder,
a message bus, ...).  Each micro-batch is scored against a persisted index
with the batch operators (broadcast query terms, partial sums, top-k limit)
inside ``foreachBatch``: ranking windows and joins against the large static
index are batch work, and the index is read, not rebuilt, per batch.

The sink is idempotent: every micro-batch writes its own ``batch_id``
partition with dynamic partition overwrite, so a batch replayed after a
failure replaces its earlier output instead of duplicating it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import lexical
from ..operators.ranking import top_k_per_query
from ..session import checkpoint_dir, scratch_path, scratch_scope

QUERY_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("query_text", T.StringType(), True),
])


def save_bm25_index(index: lexical.BM25Index, path: str) -> None:
    """Persist postings and term statistics (with the corpus constants)."""
    index.postings.write.mode("overwrite").parquet(os.path.join(path, "postings"))
    ts = index.term_stats.select("term", "df", "idf",
                                 index.n_docs.alias("n_docs"), index.avgdl.alias("avgdl"))
    ts.write.mode("overwrite").parquet(os.path.join(path, "term_stats"))


def load_bm25_index(spark: SparkSession, path: str, k1: float = lexical.BM25_K1,
                    b: float = lexical.BM25_B) -> lexical.BM25Index:
    postings = spark.read.parquet(os.path.join(path, "postings"))
    ts = spark.read.parquet(os.path.join(path, "term_stats"))
    n_docs = ts.select(F.max("n_docs")).scalar()
    avgdl = ts.select(F.max("avgdl")).scalar()
    return lexical.BM25Index(postings, ts.select("term", "df", "idf"), n_docs, avgdl, k1, b)


def stream_bm25_top_k(queries: DataFrame, index_path: str, out_path: str, k: int = 10,
                      checkpoint: str | None = None, trigger: dict | None = None):
    """Start a streaming query scoring every arriving query; returns the
    StreamingQuery.  ``queries`` is a streaming DataFrame (query_id, query_text)."""
    spark = queries.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")

    def score(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            index = load_bm25_index(batch.sparkSession, index_path)
            top = top_k_per_query(lexical.bm25_scores(index, batch), k)
            (top.withColumn("batch_id", F.lit(batch_id).cast("long"))
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id").parquet(out_path))

    writer = queries.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def query_file_stream(spark: SparkSession, folder: str, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Queries landing as files in ``folder`` (fixed schema, no inference)."""
    checkpoint_dir(spark)
    r = spark.readStream.schema(QUERY_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)
