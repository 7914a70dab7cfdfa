"""A BM25 index that is kept: sorted postings in appendable segments.

``path``/postings/segment=<name>   term, doc_id, tf, dl; range-partitioned and
                                   sorted by term, in row groups of
                                   ``ROW_GROUP_BYTES``, so a term's postings lie
                                   in few row groups of few files
``path``/terms/segment=<name>      term, df
``path``/docs/segment=<name>       one row: documents, total length

Adding documents writes a new segment and touches no other.  An index is read
over all segments: document frequencies, document counts and lengths are sums
of the segments' (map-side combined), so scores equal those of one index over
all documents.  A document must be in one segment only.

Readers push the query terms to the scan as ranges of the sorted terms; row
groups outside of them are skipped by their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BM25_B, BM25_EPSILON, BM25_K1, BROADCAST_MAX_BYTES
from ..functions.text import text_as_string, tokenize
from ..session import materialize
from .lexical import BM25Index, _scalar, bm25_statistics, bm25_top, bytes_at_most, count_terms, query_term_counts

ROW_GROUP_BYTES = 1 << 20
MAX_RANGES = 64


def add_segment(corpus: DataFrame, path: str, segment: str, null_text: str = "") -> None:
    """Index corpus(doc_id, text) as a new segment; raises if it exists."""
    rows = materialize(count_terms(corpus, F.col("doc_id"), tokenize(text_as_string("text", null_text)),
                                   stats=True), "postings")
    postings = rows.filter(F.col("term").isNotNull()).select("term", "doc_id", "tf", "dl")
    postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id") \
        .write.mode("errorifexists").option("parquet.block.size", ROW_GROUP_BYTES) \
        .parquet(f"{path}/postings/segment={segment}")
    postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("errorifexists") \
        .parquet(f"{path}/terms/segment={segment}")
    # documents without a token count as well
    rows.filter("_head").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")) \
        .write.mode("errorifexists").parquet(f"{path}/docs/segment={segment}")


def open_index(spark: SparkSession, path: str, k1: float = BM25_K1, b: float = BM25_B,
               epsilon: float = BM25_EPSILON) -> BM25Index:
    """The index over all segments of ``path``."""
    docs = spark.read.parquet(f"{path}/docs").agg(F.sum("n").cast("double").alias("n"),
                                                  (F.sum("total") / F.sum("n")).alias("avgdl"))
    docs = materialize(docs, "doc_stats")
    n_docs, avgdl = _scalar(docs, F.col("n")), _scalar(docs, F.col("avgdl"))
    df_ = spark.read.parquet(f"{path}/terms").groupBy("term").agg(F.sum("df").alias("df"))
    postings = spark.read.parquet(f"{path}/postings").select("doc_id", "dl", "term", "tf")
    return BM25Index(postings, bm25_statistics(df_, n_docs, epsilon), n_docs, avgdl, k1, b)


def term_ranges(terms: list[str], n: int = MAX_RANGES) -> Column:
    """A filter on ``term``: at most ``n`` ranges that hold all of ``terms``."""
    terms = sorted(set(terms), key=lambda t: t.encode())
    step = -(-len(terms) // n) or 1
    out = F.lit(False)
    for i in range(0, len(terms), step):
        part = terms[i:i + step]
        out = out | F.col("term").between(part[0], part[-1])
    return out


def saved_top_k(index: BM25Index, queries: DataFrame, k: int = 10,
                max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Top-k of queries(query_id, query_text) that reads the ranges of their
    terms only; the terms reach the driver behind a check of their bytes."""
    terms = materialize(query_term_counts(queries).select("term").distinct(), "query_words")
    if bytes_at_most(terms, max_bytes):
        words = [r["term"] for r in terms.collect()]
        index = BM25Index(index.postings.filter(term_ranges(words)), index.term_stats, index.n_docs,
                          index.avgdl, index.k1, index.b)
    return bm25_top(index, queries, k)
