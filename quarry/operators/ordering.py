"""Order statistics without a single-task sort.

``dense_index`` numbers rows 0..n-1 in key order (per group) and
``count_preceding`` counts, for each probe row, the points of its group that
sort strictly before it.  Both range-partition the rows on (group, key), so
the range partitioner splits even a group holding a third of all rows across
many tasks; each task then numbers its rows locally and a small table of
per-(partition, group) counts supplies the offsets.  No window spans a whole
group and nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_PID = "_q_pid"
_POS = "_q_pos"
_W = "_q_w"
_LOW33 = (1 << 33) - 1


def _positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-partition and sort, then tag each row with (partition, position).

    The result is checkpointed: positions come from the physical layout, so
    every later branch must read the very same rows."""
    s = df.repartitionByRange(*order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    s = s.withColumn("_q_mid", mid)
    s = s.withColumn(_PID, F.shiftright("_q_mid", 33)).withColumn(
        _POS, F.col("_q_mid").bitwiseAND(F.lit(_LOW33))).drop("_q_mid")
    return materialize(s)


def _offsets(tagged: DataFrame, group: list[str], weight: str | None) -> DataFrame:
    """Per (partition, group): first position and the weight in all earlier
    partitions of the same group.  One row per (partition, group) pair, so at
    most #partitions + #groups rows."""
    w = F.col(weight) if weight else F.lit(1)
    stats = tagged.groupBy(_PID, *group).agg(
        F.min(_POS).alias("_q_first"), F.sum(w).cast("long").alias("_q_n"))
    win = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(_PID) \
        .rowsBetween(Window.unboundedPreceding, -1)
    if not group:
        # one row per partition: the window is bounded by the partition count
        win = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return stats.withColumn(
        "_q_off", F.coalesce(F.sum("_q_n").over(win), F.lit(0)).cast("long")
    ).drop("_q_n")


def dense_index(df: DataFrame, order: list[str | Column], index_col: str = "idx",
                group: list[str] | None = None) -> DataFrame:
    """0-based position of each row in ``order`` (within ``group``)."""
    group = group or []
    order_cols = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o
                                              for o in order]
    tagged = _positions(df, order_cols)
    offs = _offsets(tagged, group, None)
    out = tagged.join(offs, [_PID, *group])
    out = out.withColumn(index_col, (F.col("_q_off") + F.col(_POS) - F.col("_q_first"))
                         .cast("long"))
    return out.drop(_PID, _POS, "_q_first", "_q_off")


def count_preceding(points: DataFrame, probes: DataFrame, group: list[str],
                    keys: list[str], out_col: str = "n_before") -> DataFrame:
    """For each probe row, the number of ``points`` rows of the same group
    whose key tuple is strictly smaller (ascending order on ``keys``).

    ``points`` needs the group and key columns; ``probes`` the same plus any
    payload columns, which are returned unchanged next to ``out_col``."""
    payload = [c for c in probes.columns if c not in set(group) | set(keys)]
    cols = group + keys
    pts = points.select(*cols, *[F.lit(None).cast(dict(probes.dtypes)[c]).alias(c)
                                 for c in payload], F.lit(1).alias(_W))
    prb = probes.select(*cols, *payload, F.lit(0).alias(_W))
    # a probe sorts before an equal point, so equal keys are not counted
    order = [F.col(c) for c in cols] + [F.col(_W)]
    tagged = _positions(pts.unionByName(prb), order)
    offs = _offsets(tagged, group, _W)
    p = tagged.filter(F.col(_W) == 0)
    # probes ahead of this one in the same partition and group (bounded by
    # the partition size, not the group size)
    p = p.withColumn("_q_pa", F.row_number().over(
        Window.partitionBy(_PID, *group).orderBy(_POS)) - 1)
    p = p.join(offs, [_PID, *group])
    p = p.withColumn(out_col, (F.col("_q_off") + F.col(_POS) - F.col("_q_first")
                               - F.col("_q_pa")).cast("long"))
    return p.select(*cols, *payload, out_col)
