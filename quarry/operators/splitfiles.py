"""Split-wise preprocessing of pre-split citation edge lists into query and
corpus JSON-lines files.

An edge is kept when both endpoints have a (non-null) text.  Queries are
grouped per split and citing paragraph; the corpus is every paragraph on a
kept edge of any split.  Ids are grouped first and texts joined afterwards,
so a text is never copied once per edge.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files


def _known(paragraphs: DataFrame, name: str) -> DataFrame:
    return paragraphs.filter(F.col("text").isNotNull()).select(F.col("par_id").alias(name))


def drop_unresolved_edges(edges: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Edges whose two endpoints both have a text (semi joins, ids only)."""
    e = edges.join(_known(paragraphs, "par_id_from"), "par_id_from", "left_semi")
    return e.join(_known(paragraphs, "par_id_to"), "par_id_to", "left_semi")


def edge_text_lookup(edges: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Kept edges with both texts (two inner joins on the paragraph id)."""
    t = paragraphs.filter(F.col("text").isNotNull())
    e = edges.join(t.select(F.col("par_id").alias("par_id_from"),
                            F.col("text").alias("citing_text")), "par_id_from")
    return e.join(t.select(F.col("par_id").alias("par_id_to"),
                           F.col("text").alias("cited_text")), "par_id_to")


def queries_by_split(resolved: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(split, query_id, query_text, relevant_docs, n_relevant): cited ids per
    citing paragraph and split, duplicates kept, ascending."""
    g = resolved.groupBy("split", "par_id_from").agg(
        F.sort_array(F.collect_list("par_id_to")).alias("relevant_docs"),
        F.count(F.lit(1)).alias("n_relevant"))
    t = paragraphs.select(F.col("par_id").alias("par_id_from"), F.col("text").alias("query_text"))
    return g.join(t, "par_id_from").select(
        "split", F.col("par_id_from").alias("query_id"), "query_text", "relevant_docs",
        "n_relevant")


def paragraphs_on_edges(resolved: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Distinct paragraphs on any kept edge, as (doc_id, text)."""
    ids = resolved.select(F.col("par_id_from").alias("doc_id")).unionByName(
        resolved.select(F.col("par_id_to").alias("doc_id"))).distinct()
    t = paragraphs.select(F.col("par_id").alias("doc_id"), "text")
    return ids.join(t, "doc_id")


def write_split_jsonl(edges: DataFrame, paragraphs: DataFrame, base: str) -> dict[str, str]:
    """Writes train / validation / test query files and the corpus file.
    Returns the paths."""
    resolved = drop_unresolved_edges(edges, paragraphs)
    q = queries_by_split(resolved, paragraphs)
    out = {}
    for name in files.SPLIT_NAMES:
        out[name] = os.path.join(base, name)
        files.write_jsonl(q.filter(F.col("split") == name).drop("split", "n_relevant"), out[name])
    out["corpus"] = os.path.join(base, "corpus")
    files.write_jsonl(paragraphs_on_edges(resolved, paragraphs), out["corpus"])
    return out
