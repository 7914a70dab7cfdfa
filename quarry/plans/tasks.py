"""Task inputs derived from the driver tables (see FIXTURES.md).

* lexical task: corpus = documents, queries = benchmark, qrels = documents
  that contain the benchmark passage;
* temporal citation task: paragraphs with a date and a citation edge list,
  both derived from ``documents`` by integer arithmetic;
* dense task: leave-one-out over all embeddings (every vector queries all
  the others), relevance = same label among the next ten ids;
* pair task: the lexical qrels pairs with both texts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_words
from ..config import BROADCAST_MAX_BYTES
from ..operators.lexical import bytes_at_most
from ..session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  A large table arrives in many splits; a small one
    (here: a single row group) would put all its text work in one task, so
    it is hash-spread by its id column to the cluster's parallelism.  The
    id partitioning is then reused by per-document aggregations."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    par = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        df = df.repartition(par, df.columns[0])
    return df


# ---------------------------------------------------------------- lexical

def lexical_corpus(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def lexical_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def contains_pairs(docs: DataFrame, passages: DataFrame,
                   max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """(query_id, doc_id) where the doc text contains the passage text.

    No nested-loop join: every whitespace-delimited token strictly inside a
    passage is a whole token of any text containing it, so the passage's
    longest inner token is an exact equi-join key for candidates, which
    ``contains`` then verifies.  Passages of one or two tokens have no inner
    token; they are searched in every text as broadcast blocks of at most
    ``max_bytes``.  Passages without a token are ignored."""
    toks = split_words("query_text")
    p = passages.select("query_id", "query_text", toks.alias("_t"))
    inner = F.slice(F.col("_t"), 2, F.greatest(F.size("_t") - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("l"), t.alias("t"))))
    anchors = p.filter(F.size("_t") >= 3).select("query_id", longest["t"].alias("anchor"))
    anchors = materialize(anchors, "anchors")
    dtok = docs.select("doc_id", F.explode(F.array_distinct(split_words("text"))).alias("anchor"))
    a = F.broadcast(anchors) if bytes_at_most(anchors, max_bytes) else anchors
    cand = materialize(dtok.join(a, "anchor").select("query_id", "doc_id").distinct(), "candidate_pairs")
    cand = cand.join(passages.select("query_id", "query_text"), "query_id")
    if bytes_at_most(cand, max_bytes):
        cand = F.broadcast(cand)            # texts stay in their tasks
    out = docs.select("doc_id", "text").join(cand, "doc_id") \
        .filter(F.col("text").contains(F.col("query_text"))).select("query_id", "doc_id")
    short = p.filter(F.size("_t").between(1, 2)).select("query_id", "query_text")
    n_bytes = short.agg(F.sum(F.octet_length("query_text") + 24)).first()[0] or 0
    blocks = -(-n_bytes // max_bytes)
    for i in range(blocks):
        rows = short.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        if rows:
            out = out.unionByName(_short_matches(docs, [tuple(r) for r in rows]))
    return out


def _short_matches(docs: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def search(batches):
        for b in batches:
            hits = [(q, d) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t
                    for q, p in shared.value if p in t]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h[i] for h in hits], type=pa.int64()) for i in (0, 1)],
                ["query_id", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(search, "query_id long, doc_id long")


def lexical_qrels(spark, sf_dir) -> DataFrame:
    return contains_pairs(lexical_corpus(spark, sf_dir), lexical_queries(spark, sf_dir))


# --------------------------------------------------------------- temporal

def paragraphs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    date = F.make_date((F.lit(2010) + F.col("doc_id") % 13).cast("int"),
                       (F.lit(1) + F.col("doc_id") % 12).cast("int"),
                       (F.lit(1) + F.col("doc_id") % 28).cast("int"))
    return d.select(F.col("doc_id").alias("par_id"), "text", date.alias("date"))


def citations(spark, sf_dir) -> DataFrame:
    """Three edges for 4 of every 5 paragraphs, plus a repeat of the first
    edge on every tenth paragraph (duplicates are part of the data)."""
    p = paragraphs(spark, sf_dir).select("par_id")
    n = p.select(F.count(F.lit(1))).scalar()
    three = p.filter(F.col("par_id") % 5 != 4).select(
        "par_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"))
    three = three.select(F.col("par_id").alias("par_id_from"),
                         ((F.col("par_id") * 7 + F.col("j") * 13 + 1) % n).alias("par_id_to"))
    rep = p.filter(F.col("par_id") % 10 == 0).select(
        F.col("par_id").alias("par_id_from"),
        ((F.col("par_id") * 7 + 1) % n).alias("par_id_to"))
    return three.unionByName(rep)


def split_edges(spark, sf_dir) -> DataFrame:
    """Citation edges labelled with the citing paragraph's split, plus
    unresolved edges (target -1) on every twentieth paragraph."""
    from ..operators.split import temporal_split
    e = citations(spark, sf_dir)
    bad = paragraphs(spark, sf_dir).filter(F.col("par_id") % 20 == 3).select(
        F.col("par_id").alias("par_id_from"), F.lit(-1).cast("long").alias("par_id_to"))
    e = e.unionByName(bad)
    yrs = temporal_split(paragraphs(spark, sf_dir)).select(
        F.col("par_id").alias("par_id_from"), "split")
    e = e.join(yrs, "par_id_from").filter(F.col("split").isNotNull())
    return e.withColumn("split", F.when(F.col("split") == "val", F.lit("validation"))
                        .otherwise(F.col("split")))


# ------------------------------------------------------------------ dense

def dense_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


def dense_queries(spark, sf_dir) -> DataFrame:
    """Every vector is a query (its own row is excluded when scoring)."""
    return dense_vectors(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "vec", "label")


def dense_qrels(spark, sf_dir) -> DataFrame:
    """A vector's relevant docs: those of its label among the next ten ids
    (at most ten per query, whatever the size of a label)."""
    v = dense_vectors(spark, sf_dir).select("doc_id", "label")
    near = v.select(F.col("doc_id").alias("query_id"), "label",
                    F.explode(F.sequence(F.lit(1), F.lit(10))).alias("step"))
    return near.select("query_id", "label", (F.col("query_id") + F.col("step")).alias("doc_id")) \
        .join(v, ["doc_id", "label"]).select("query_id", "doc_id")


# ------------------------------------------------------------------ pairs

def text_pairs(spark, sf_dir) -> DataFrame:
    """(query_id, doc_id, query_text, doc_text) for the lexical qrels."""
    qr = lexical_qrels(spark, sf_dir)
    q = lexical_queries(spark, sf_dir)
    d = lexical_corpus(spark, sf_dir).withColumnRenamed("text", "doc_text")
    return qr.join(q, "query_id").join(d, "doc_id").select(
        "query_id", "doc_id", "query_text", "doc_text")


def conversation_pairs(spark, sf_dir) -> DataFrame:
    """User turn -> the next assistant turn of the same conversation."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("query_text"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("positive_text"))
    return u.join(a, ["conv_id", "turn"])
