"""Connected components of an edge table, as joins and aggregations.

Alternating large-star and small-star steps: in each, a node's smallest
neighbour is a min aggregated on the map side, and a join hands it to the
other neighbours.  A node with a third of all edges costs one row per task in
the aggregation, and its join rows are split at run time (both sides are
plain shuffles of written tables).  Edges never leave the cluster; each round
is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) with u > v: nodes link to the smallest node
    of their neighbourhood."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    low = near.groupBy("u").agg(F.min("v").alias("m"))
    low = materialize(low.select("u", F.least("u", "m").alias("m")), "component_minima")
    j = near.join(low, "u")
    if large:   # neighbours above the node link to the minimum
        out = j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:       # the node and its smaller neighbours link to the minimum
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; any orderable
    type): root is the smallest node of its component.  Edges with a null end
    and self-links are ignored; an empty table gives an empty result."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"),
                     (F.col("a") != F.col("b")).alias("__x")) \
        .filter(F.col("__x")).select("u", "v").distinct()
    e = materialize(e, "component_edges")
    for _ in range(MAX_ROUNDS):
        # finished when every node has one link, and to a node that has none
        n = e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("u")).first()
        if n["n"] == 0:
            break
        if n["n"] == n["u"] and e.join(e.select(F.col("u").alias("v")), "v", "left_semi") \
                .limit(1).count() == 0:
            break
        e = materialize(_star(materialize(_star(e, True), "component_edges"), False),
                        "component_edges")
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
