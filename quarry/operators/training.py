"""Training data for contrastive fine-tuning: positive pairs, seeded batches
whose other members act as in-batch negatives, and nested subsets for a
training-size ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TRAIN_BATCH_SIZE
from ..functions.text import text_as_string
from .ordering import dense_index


def positive_pairs(train_edges: DataFrame, paragraphs: DataFrame,
                   null_text: str = "") -> DataFrame:
    """(query_id, doc_id, dup, query_text, positive_text) per training
    citation.  Duplicate citations stay (``dup`` numbers the copies); targets
    missing from the paragraph table are dropped."""
    texts = paragraphs.select("par_id", text_as_string("text", null_text).alias("t"))
    e = train_edges.select(F.col("par_id_from").alias("query_id"),
                           F.col("par_id_to").alias("doc_id"))
    e = e.withColumn("dup", F.row_number().over(
        Window.partitionBy("query_id", "doc_id").orderBy(F.lit(0))).cast("long") - 1)
    e = e.join(texts.withColumnRenamed("par_id", "query_id")
               .withColumnRenamed("t", "query_text"), "query_id")
    e = e.join(texts.withColumnRenamed("par_id", "doc_id")
               .withColumnRenamed("t", "positive_text"), "doc_id")
    return e.select("query_id", "doc_id", "dup", "query_text", "positive_text")


def shuffle_key(seed: int, *id_cols: str):
    """Deterministic pseudo-random order key: md5 of the seed and pair id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols]))


def training_batches(pairs: DataFrame, id_cols: list[str], seed: int = 42,
                     batch_size: int = TRAIN_BATCH_SIZE) -> DataFrame:
    """Adds batch_id and slot: a seeded shuffle (range-sorted key, dense
    index), cut into consecutive batches of ``batch_size``."""
    keyed = pairs.withColumn("_key", shuffle_key(seed, *id_cols))
    idx = dense_index(keyed, ["_key", *id_cols], "_idx")
    return idx.withColumn("batch_id", F.floor(F.col("_idx") / batch_size).cast("long")) \
              .withColumn("slot", (F.col("_idx") % batch_size).cast("long")).drop("_key", "_idx")


def subset_bucket(id_col: str = "query_id"):
    """A fixed pseudo-random bucket 0..99 per id, from its md5 digest."""
    digest = F.md5(F.concat(F.lit("subset:"), F.col(id_col).cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(100))


def nested_train_subsets(train_queries: DataFrame, step: int = 10) -> DataFrame:
    """Nested subsets (10 %, 20 %, ..., 100 %): a query with bucket b belongs
    to every fraction p > b.  Returns (fraction, n_queries, n_pairs), with
    fraction p holding all queries of smaller fractions."""
    q = train_queries.select(
        (F.floor(subset_bucket("query_id") / step) * step + step).cast("long").alias("fraction"),
        F.col("n_relevant").cast("long").alias("np"))
    g = q.groupBy("fraction").agg(F.count(F.lit(1)).alias("nq"), F.sum("np").alias("npairs"))
    # fractions are at most 100/step rows: a global running sum is fine
    w = Window.orderBy("fraction").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("fraction", F.sum("nq").over(w).cast("long").alias("n_queries"),
                    F.sum("npairs").over(w).cast("long").alias("n_pairs"))
