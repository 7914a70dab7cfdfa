"""Ranking within a query: top-k, full ranking, score filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def rounded_score(col="score"):
    """The ranking key: the score at float32 precision (relative, about 7
    significant digits), so sums that differ only in the last bits of a
    double -- summation order -- compare equal in every engine."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("float").cast("double")


def rank_window(query_col: str = "query_id", doc_col: str = "doc_id",
                score_col: str = "score"):
    """Best first: score (float32 precision) descending, then doc id ascending."""
    return Window.partitionBy(query_col).orderBy(
        rounded_score(score_col).desc(), F.col(doc_col).asc())


def top_k_per_query(run: DataFrame, k: int, query_col: str = "query_id",
                    doc_col: str = "doc_id", score_col: str = "score",
                    rank_col: str = "rank") -> DataFrame:
    """Best ``k`` rows per query with their 1-based rank.

    Planned as WindowGroupLimit: a partial top-k runs before the shuffle, so
    each query's group holds at most k rows per upstream partition.  A run that
    carries its scorer isn't built and sorted: the scoring tasks keep the best."""
    scorer = vars(run).get("_scorer")
    if scorer is not None and (query_col, doc_col, score_col, rank_col) == ("query_id", "doc_id", "score", "rank"):
        return scorer.top(k)
    w = rank_window(query_col, doc_col, score_col)
    return (run.withColumn(rank_col, F.row_number().over(w).cast("long"))
               .filter(F.col(rank_col) <= k))


def full_ranking(run: DataFrame, query_col: str = "query_id", doc_col: str = "doc_id",
                 score_col: str = "score", rank_col: str = "rank") -> DataFrame:
    """Rank every scored row of every query (1-based), without a per-query
    single-task sort: positions come from a range-partitioned global order."""
    from ..session import materialize
    from .ordering import dense_index
    run = materialize(run, "run")       # range partitioning reads it twice
    ranked = dense_index(
        run.withColumn("_neg", -rounded_score(score_col)),
        order=["_neg", doc_col], index_col="_idx", group=[query_col])
    return ranked.withColumn(rank_col, F.col("_idx") + 1).drop("_idx", "_neg")


def score_pair_filter(run: DataFrame, corpus: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Drop scored docs that are not in the corpus (left semi join)."""
    return run.join(corpus.select(doc_col), doc_col, "left_semi")


def score_profiles(run: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, n_docs, n_scored, total, top): the zero-filled score table of
    each query, summed up in closed form -- unscored docs add nothing to the
    total and 0 to the maximum -- so the table itself is never built."""
    n = corpus.select(F.count(F.lit(1))).scalar()
    got = run.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_scored"), F.sum("score").alias("total"),
                                      F.max("score").alias("top"))
    out = queries.select("query_id").join(got, "query_id", "left").withColumn("n_docs", n)
    scored = F.coalesce("n_scored", F.lit(0))
    return out.select(
        "query_id", "n_docs", scored.alias("n_scored"), F.coalesce("total", F.lit(0.0)).alias("total"),
        F.when(scored == F.col("n_docs"), F.col("top"))
        .otherwise(F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0))).alias("top"))
