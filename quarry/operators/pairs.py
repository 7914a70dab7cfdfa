"""Text-pair analysis over a pair table (one row per (query, doc) pair):
word-level edit distance, shared word n-grams, longest common subsequence,
and their averages by which of two models ranked the pair's query better.

Shared n-grams are built-in array functions.  The two dynamic programmes
run as Arrow-batched Pandas UDFs over whole token arrays, both bit-parallel:
64 cells of the table per word operation, one pass per token of the shorter
text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenize, word_ngrams


def _masks(tokens) -> dict:
    """Bit i of a token's mask: it is token i."""
    masks: dict = {}
    for i, x in enumerate(tokens):
        masks[x] = masks.get(x, 0) | (1 << i)
    return masks


def edit_distance_tokens(a, b) -> int:
    """Levenshtein distance over token sequences, unit costs (bit-vectors: a
    column of the table is held as the signs of its vertical differences, one
    bit each, and moves on by a dozen word operations per 64 tokens)."""
    if a is None or b is None:
        return None
    if len(a) < len(b):
        a, b = b, a
    m = len(a)
    if len(b) == 0:
        return m
    masks, full, last = _masks(a), (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m        # differences of +1 and of -1
    for y in b:
        same = masks.get(y, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up = down | (full & ~(diagonal | up))
        right_down = up & diagonal
        if right_up & last:
            distance += 1
        elif right_down & last:
            distance -= 1
        right_up = ((right_up << 1) | 1) & full
        right_down = (right_down << 1) & full
        up = right_down | (full & ~((same | down) | right_up))
        down = right_up & (same | down)
    return distance


def lcs_tokens(a, b) -> int:
    """Longest common subsequence length over token sequences (bit-parallel:
    S <- ((S + u) | (S - u)) with u = S & mask[token])."""
    if a is None or b is None:
        return None
    if len(a) < len(b):
        a, b = b, a
    if len(b) == 0:
        return 0
    masks, full = _masks(a), (1 << len(a)) - 1
    s = full
    for y in b:
        m = masks.get(y)
        if m is None:
            continue
        u = s & m
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


@F.pandas_udf(T.LongType())
def _edit_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance_tokens(x, y) for x, y in zip(a, b)], dtype="Int64")


@F.pandas_udf(T.LongType())
def _lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_tokens(x, y) for x, y in zip(a, b)], dtype="Int64")


def _tok(col):
    return tokenize(F.coalesce(F.col(col), F.lit("")))


def pair_word_edit_distance(pairs: DataFrame, a: str = "query_text", b: str = "doc_text",
                            out: str = "edit_distance") -> DataFrame:
    return pairs.withColumn(out, _edit_udf(_tok(a), _tok(b)))


def pair_common_ngrams(pairs: DataFrame, n: int = 2, a: str = "query_text",
                       b: str = "doc_text", out: str | None = None) -> DataFrame:
    """Number of distinct word n-grams present in both texts."""
    ga = F.array_distinct(word_ngrams(_tok(a), n))
    gb = F.array_distinct(word_ngrams(_tok(b), n))
    return pairs.withColumn(out or f"common_{n}grams", F.size(F.array_intersect(ga, gb)).cast("long"))


def pair_lcs(pairs: DataFrame, a: str = "query_text", b: str = "doc_text",
             out: str = "lcs") -> DataFrame:
    return pairs.withColumn(out, _lcs_udf(_tok(a), _tok(b)))


def pair_features(pairs: DataFrame, n: int = 2, a: str = "query_text",
                  b: str = "doc_text") -> DataFrame:
    p = pair_word_edit_distance(pairs, a, b)
    p = pair_common_ngrams(p, n, a, b, "common_ngrams")
    return pair_lcs(p, a, b)


def overlap_by_outcome(gap: DataFrame, pair_feats: DataFrame) -> DataFrame:
    """Average pair features of relevant pairs, by which model won the query
    (gap = metric_a - metric_b per query)."""
    outcome = (F.when(F.col("gap") > 0, F.lit("a_better"))
                .when(F.col("gap") < 0, F.lit("b_better")).otherwise(F.lit("tie")))
    g = gap.select("query_id", outcome.alias("outcome"))
    j = pair_feats.join(g, "query_id")
    return j.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("edit_distance").alias("avg_edit_distance"),
        F.avg("common_ngrams").alias("avg_common_ngrams"),
        F.avg("lcs").alias("avg_lcs"))
