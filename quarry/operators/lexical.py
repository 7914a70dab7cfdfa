"""Lexical retrieval: BM25 (Okapi, idf floor) and TF-IDF n-gram cosine.

Indexes are plain DataFrames in long form:

* postings(doc_id, dl, term, tf) -- terms are counted inside the document's
  task, so building them needs no exchange of text or tokens;
* term_stats(term, df, idf) -- one aggregation keyed by term (partial
  aggregation before the shuffle, so a hot term costs one row per task).

Both are written once; every statistic and scoring job reads them.  Scoring
sums up each query's terms inside the documents' tasks, in tiles of queries and
documents (``score_tiles``); where only the best k are asked for and the
queries can be broadcast, by impact bounds (``impact``).  Neither makes a row per
(query term, posting).  ``term_match_join`` does, for its callers: the query-term
side is broadcast only after its bytes are summed; beyond the bound the join is
a shuffle on (term, salt) where the postings of hot terms are spread over several
tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (BM25_B, BM25_EPSILON, BM25_K1, BROADCAST_MAX_BYTES, MAX_HOT_TERMS,
                      ROWS_PER_SALT, TFIDF_VOCAB_SIZE)
from ..functions.stopwords import ENGLISH
from ..functions.text import text_as_string, tokenize
from ..session import materialize
from .heavy_terms import COUNTERS, top_candidates
from .impact import impact_top_k
from .ngrams import lengths, slice_ngrams
from .ngrams import token_slices as _token_slices
from .ranking import top_k_per_query
from .score_tiles import Scorer


def default_stop_words() -> list[str]:
    """The English stop words removed before n-grams are built."""
    return list(ENGLISH)


def table_bytes(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take (strings by their length, other
    columns as 8 bytes, 16 per row)."""
    size = F.lit(16)
    for name, kind in df.dtypes:
        size = size + (F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(8))
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def bytes_at_most(df: DataFrame, limit: int) -> bool:
    """True when the rows of ``df`` take at most ``limit`` bytes."""
    return table_bytes(df) <= limit


def _scalar(df: DataFrame, expr: Column) -> Column:
    """A one-value aggregate as an uncorrelated scalar subquery column."""
    return df.select(expr).scalar()


# --------------------------------------------------------------------- BM25

@dataclass
class BM25Index:
    postings: DataFrame      # doc_id, dl, term, tf
    term_stats: DataFrame    # term, df, raw_idf, idf
    n_docs: Column           # scalar subquery
    avgdl: Column            # scalar subquery
    k1: float
    b: float


def count_terms(rows: DataFrame, key: Column, tokens: Column, tf_col: str = "tf",
                stats: bool = False) -> DataFrame:
    """(key, term, tf): the terms of each row, counted inside its task, so no
    exchange is needed.  ``stats``: also the row's length ``dl`` and ``_head``,
    true on one row of each document; a row without tokens then keeps one row,
    with a null term.

    A batch's tokens are dictionary-encoded and counted by (row, code) with
    NumPy, ``SLICE_TOKENS`` at a time; in built-in functions this takes an exchange of all tokens, or
    nested lambdas that evaluate the sorted array many times over."""
    r = rows.select(key, tokens.alias("_tk"))
    name = r.columns[0]
    extra = ", dl long, _head boolean" if stats else ""

    def count(batches):
        for b in _token_slices(batches):
            col = b.column(1)
            sizes = lengths(col)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            code = col.flatten().dictionary_encode()
            width = max(len(code.dictionary), 1)
            pair, tf = np.unique(owner * width + code.indices.to_numpy(zero_copy_only=False),
                                 return_counts=True)
            own, term = pair // width, pair % width
            terms = code.dictionary.take(pa.array(term))
            if stats:
                none = np.flatnonzero(sizes == 0)
                own = np.concatenate((own, none))
                terms = pa.concat_arrays([terms, pa.nulls(len(none), terms.type)])
                tf = np.concatenate((tf, np.zeros(len(none), dtype=tf.dtype)))
            cols = [b.column(0).take(pa.array(own)), terms, pa.array(tf.astype(np.int64))]
            names = [name, "term", tf_col]
            if stats:
                head = np.ones(len(own), dtype=bool)
                head[1:] = own[1:] != own[:-1]
                cols += [pa.array(sizes[own]), pa.array(head)]
                names += ["dl", "_head"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = dict(r.dtypes)[name]
    return r.mapInArrow(count, f"{name} {kind}, term string, {tf_col} long{extra}")


def bm25_index(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               k1: float = BM25_K1, b: float = BM25_B, epsilon: float = BM25_EPSILON,
               null_text: str = "") -> BM25Index:
    """One pass over the text builds the postings, without an exchange; they
    and the term statistics are written once."""
    toks = tokenize(text_as_string(text_col, null_text))
    rows = materialize(count_terms(corpus, F.col(id_col).alias("doc_id"), toks, stats=True), "postings")
    # empty documents keep one row (term null): they count in N and avgdl
    stats = rows.filter("_head").agg(F.count(F.lit(1)).cast("double").alias("n"),
                                     F.avg("dl").alias("avgdl"))
    stats = materialize(stats, "doc_stats")
    n_docs, avgdl = _scalar(stats, F.col("n")), _scalar(stats, F.col("avgdl"))
    postings = rows.filter(F.col("term").isNotNull()).select("doc_id", "dl", "term", "tf")
    df_ = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return BM25Index(postings, bm25_statistics(df_, n_docs, epsilon), n_docs, avgdl, k1, b)


def bm25_statistics(df_: DataFrame, n_docs: Column, epsilon: float = BM25_EPSILON) -> DataFrame:
    """term, df, raw_idf, idf from (term, df); negative raw values get the floor."""
    raw = F.ln(n_docs - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    with_raw = materialize(df_.withColumn("raw_idf", raw), "term_stats")
    mean_raw = _scalar(with_raw, F.avg("raw_idf"))
    return with_raw.withColumn(
        "idf", F.when(F.col("raw_idf") < 0, F.lit(epsilon) * mean_raw)
                .otherwise(F.col("raw_idf")))


def query_term_counts(queries: DataFrame, id_col: str = "query_id",
                      text_col: str = "query_text", null_text: str = "") -> DataFrame:
    """(query_id, term, qtf): repeated query tokens count repeatedly."""
    return count_terms(queries, F.col(id_col).alias("query_id"),
                       tokenize(text_as_string(text_col, null_text)), tf_col="qtf")


def term_match_join(postings: DataFrame, query_terms: DataFrame,
                    max_broadcast_bytes: int = BROADCAST_MAX_BYTES,
                    rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """postings(doc_id, term, ...) JOIN query_terms(term, ...) on term.

    A query side within ``max_broadcast_bytes`` is broadcast: postings of its
    terms go to their document's task and the join adds no exchange, so sums
    by (query, document) need none either.  Otherwise: a shuffle join on
    (term, salt).  A term's cost is its postings times its query rows; one
    that costs more than ``rows_per_salt`` has its postings spread over as
    many salts, and its query rows copied to each.  The costly terms are few
    by choice of that bound (at most ``MAX_HOT_TERMS``) and reach the
    postings as a broadcast, never as a join on the bare term."""
    if bytes_at_most(query_terms, max_broadcast_bytes):
        wanted = F.broadcast(query_terms.select("term").distinct())
        return postings.join(wanted, "term", "left_semi").repartition(F.col("doc_id")) \
            .join(F.broadcast(query_terms), "term")
    df_ = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    qf = query_terms.groupBy("term").agg(F.count(F.lit(1)).alias("qf"))
    cost = materialize(df_.join(qf, "term").select("term", (F.col("df") * F.col("qf")).alias("cost")),
                       "term_cost")
    total = cost.agg(F.sum("cost")).first()[0] or 0
    bound = max(rows_per_salt, -(-total // MAX_HOT_TERMS))
    hot = cost.filter(F.col("cost") > bound).select(
        "term", F.ceil(F.col("cost") / bound).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    p = postings.join(F.broadcast(hot), "term", "left").withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int")).drop("_salts")
    q = query_terms.join(F.broadcast(hot), "term", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return p.join(q, ["term", "_salt"]).drop("_salt")


def bm25_scores(index: BM25Index, queries: DataFrame, id_col: str = "query_id",
                text_col: str = "query_text", **join_opts) -> DataFrame:
    """Sparse run (query_id, doc_id, score): every doc sharing a term.

    Each side's factor is computed first -- the saturated term frequency per
    posting, qtf * idf per query term -- and summed up in tiles (see ``_run``).
    ``join_opts``: by the join instead, with these options."""
    post, qt = _bm25_sides(index, queries, id_col, text_col)
    return _run(post, qt, join_opts)


def _run(post: DataFrame, qt: DataFrame, join_opts: dict) -> DataFrame:
    """The run of postings(doc_id, term, wd) and query terms(query_id, term, wq).
    It carries its ``Scorer``, so that it can be evaluated without being built.
    The rows of one block of queries come from tiles, of several from the join:
    blocks would have to be stored one by one."""
    scorer = Scorer(post, qt)
    if join_opts or not scorer.fits():
        return _joined_scores(post, qt, **join_opts)
    run = scorer.run() if scorer.block_count() == 1 else _joined_scores(post, qt)
    run._scorer = scorer
    return run


def _joined_scores(post: DataFrame, qt: DataFrame, *args, **opts) -> DataFrame:
    return term_match_join(post, qt, *args, **opts).groupBy("query_id", "doc_id").agg(
        F.sum(F.col("wq") * F.col("wd")).alias("score"))


def _bm25_sides(index: BM25Index, queries: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(postings(term, doc_id, wd), query terms(term, query_id, wq))."""
    qt = query_term_counts(queries, id_col, text_col)
    qt = qt.join(index.term_stats.select("term", "idf"), "term") \
        .select("term", "query_id", (F.col("qtf") * F.col("idf")).alias("wq"))
    # read twice (size check, join): write the small query side once
    qt = materialize(qt, "query_terms")
    k1, b = index.k1, index.b
    tf = F.col("tf")
    norm = tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / index.avgdl)
    return index.postings.select("term", "doc_id", ((tf * F.lit(k1 + 1)) / norm).alias("wd")), qt


def bm25_top(index: BM25Index, queries: DataFrame, k: int, id_col: str = "query_id",
             text_col: str = "query_text", max_broadcast_bytes: int = BROADCAST_MAX_BYTES, **opts) -> DataFrame:
    """Top-k run with rank: by impact bounds inside the documents' tasks, or in
    tiles, block by block, where the queries are too large to broadcast."""
    post, qt = _bm25_sides(index, queries, id_col, text_col)
    return _top(post, qt, k, max_broadcast_bytes, opts)


def _top(post: DataFrame, qt: DataFrame, k: int, max_bytes: int, opts: dict) -> DataFrame:
    run = impact_top_k(post, qt, k, max_bytes, **opts)
    if run is not None:
        return run
    scorer = Scorer(post, qt, max_bytes)
    return scorer.top(k) if scorer.fits() else top_k_per_query(_joined_scores(post, qt, max_bytes), k)


def bm25_top_k(corpus: DataFrame, queries: DataFrame, k: int = 10, k1: float = BM25_K1,
               b: float = BM25_B, epsilon: float = BM25_EPSILON, **opts) -> DataFrame:
    return bm25_top(bm25_index(corpus, k1=k1, b=b, epsilon=epsilon), queries, k, **opts)


# ------------------------------------------------------------------- TF-IDF

@dataclass
class TfidfIndex:
    weights: DataFrame       # doc_id, term, w  (L2-normalised per doc)
    vocab: DataFrame         # term, cf, df, idf
    ngram: tuple[int, int]
    stop_words: list[str]


def ngram_counts(rows: DataFrame, ngram, stop_words, id_col="doc_id", text_col="text",
                 only: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf): tokenise -> drop stop words -> n-grams (joined by a
    space), counted inside the row's task.  ``only``: of the distinct terms of
    this table; they are told to the tasks, so that no other n-gram leaves a
    task, or joined afterwards where their bytes forbid it."""
    r = rows.select(F.col(id_col).alias("doc_id"), tokenize(text_as_string(text_col, "")).alias("_tk"))
    told = only is not None and bytes_at_most(only.select("term"), BROADCAST_MAX_BYTES)
    wanted = only.select("term").toArrow().column("term").combine_chunks().cast(pa.string()) if told else None
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        wanted = shared.value
        for b in _token_slices(batches):
            own, term, texts = slice_ngrams(b.column(1), ngram, stop_words)
            if wanted is not None:
                place = pc.fill_null(pc.index_in(texts.cast(pa.string()), value_set=wanted), -1) \
                    .to_numpy(zero_copy_only=False).astype(np.int64)[term]
                own, term, texts = own[place >= 0], place[place >= 0], wanted
            width = max(len(texts), 1)
            pair, tf = np.unique(own * width + term, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(pair // width)), texts.take(pa.array(pair % width)).cast(pa.string()),
                 pa.array(tf.astype(np.int64))], ["doc_id", "term", "tf"])

    counts = r.mapInArrow(count, f"doc_id {r.dtypes[0][1]}, term string, tf long")
    return counts if only is None or told else counts.join(only.select("term"), "term")


def top_k_vocabulary(term_stats: DataFrame, size: int = TFIDF_VOCAB_SIZE) -> DataFrame:
    """The ``size`` terms with the highest total count; ties by term.
    A bounded top-k (TakeOrderedAndProject): at most ``size`` rows per task."""
    return term_stats.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(size)


def tfidf_index(corpus: DataFrame, ngram: tuple[int, int] = (1, 1),
                vocab_size: int = TFIDF_VOCAB_SIZE, stop_words: list[str] | None = None,
                vocab_corpus: DataFrame | None = None, id_col: str = "doc_id",
                text_col: str = "text", counters: int = COUNTERS) -> TfidfIndex:
    """Two passes over the text: summaries of the heaviest terms, then exact
    counts of the terms that may belong to the vocabulary, by document.  Both
    the vocabulary and the weights come from these counts (from a pass of its
    own for the weights, where the vocabulary is fitted on another corpus)."""
    if stop_words is None:
        stop_words = default_stop_words()
    fit_docs = corpus if vocab_corpus is None else vocab_corpus
    candidates = top_candidates(fit_docs, tokenize(text_as_string(text_col, "")), vocab_size, counters,
                                ngram, stop_words)
    counts = materialize(ngram_counts(fit_docs, ngram, stop_words, id_col, text_col, candidates),
                         "candidate_counts")
    stats = counts.groupBy("term").agg(
        F.sum("tf").cast("long").alias("cf"), F.count(F.lit(1)).alias("df"))
    n = _scalar(fit_docs, F.count(F.lit(1)).cast("double"))
    vocab = materialize(top_k_vocabulary(stats, vocab_size).withColumn(
        "idf", F.ln((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)), "vocabulary")
    index = TfidfIndex(None, vocab, ngram, stop_words)
    if vocab_corpus is not None:
        counts = ngram_counts(corpus, ngram, stop_words, id_col, text_col, vocab)
    index.weights = materialize(_l2_normalise(_weigh(counts, index), "doc_id")
                                .select("doc_id", "term", "w"), "weights")
    return index


def _weigh(counts: DataFrame, index: TfidfIndex) -> DataFrame:
    """tf * idf of the vocabulary's terms; the vocabulary is broadcast when
    its bytes allow it."""
    side = index.vocab.select("term", "idf")
    if bytes_at_most(side, BROADCAST_MAX_BYTES):
        side = F.broadcast(side)
    return counts.join(side, "term").withColumn("w", F.col("tf") * F.col("idf"))


def _l2_normalise(w: DataFrame, key: str) -> DataFrame:
    """Divide by the L2 norm of the key's vector: one window per key (one
    exchange by key, no join back)."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.withColumn("w", F.col("w") / norm)


def tfidf_query_weights(index: TfidfIndex, queries: DataFrame, id_col="query_id",
                        text_col="query_text") -> DataFrame:
    q = ngram_counts(queries, index.ngram, index.stop_words, id_col, text_col, index.vocab) \
        .withColumnRenamed("doc_id", "query_id")
    return _l2_normalise(_weigh(q, index), "query_id").select(
        "query_id", "term", F.col("w").alias("qw"))


def tfidf_scores(index: TfidfIndex, queries: DataFrame, id_col="query_id",
                 text_col="query_text", **join_opts) -> DataFrame:
    """Cosine of L2-normalised tf-idf vectors; zero vectors give no rows."""
    qw = materialize(tfidf_query_weights(index, queries, id_col, text_col), "query_weights")
    return _run(index.weights.withColumnRenamed("w", "wd"), qw.withColumnRenamed("qw", "wq"), join_opts)


def tfidf_top_k(corpus: DataFrame, queries: DataFrame, k: int = 10,
                ngram: tuple[int, int] = (1, 1), vocab_size: int = TFIDF_VOCAB_SIZE,
                stop_words: list[str] | None = None, vocab_corpus: DataFrame | None = None,
                **opts) -> DataFrame:
    return tfidf_top(tfidf_index(corpus, ngram, vocab_size, stop_words, vocab_corpus), queries, k, **opts)


def tfidf_top(index: TfidfIndex, queries: DataFrame, k: int, id_col="query_id", text_col="query_text",
              max_broadcast_bytes: int = BROADCAST_MAX_BYTES, **opts) -> DataFrame:
    """Top-k run with rank, as ``bm25_top``."""
    qw = materialize(tfidf_query_weights(index, queries, id_col, text_col), "query_weights")
    return _top(index.weights.withColumnRenamed("w", "wd"), qw.withColumnRenamed("qw", "wq"), k,
                max_broadcast_bytes, opts)
