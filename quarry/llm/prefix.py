"""Running sums over a global order without a single-task window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize


def running_sum(df: DataFrame, group: str, order: list[Column], weight: str,
                out: str = "before") -> DataFrame:
    """Adds the sum of ``weight`` (long) over the earlier rows of the same
    group (``group``: a non-null column).

    Rows are range-partitioned on (group, order), so a group holding a third
    of all rows spans many tasks; each task sums its own rows, and one row per
    (task, group) supplies what came before.  Written once, as the sums belong
    to this very layout."""
    schema = T.StructType([*df.schema.fields, T.StructField("__pid", T.IntegerType()),
                           T.StructField(out, T.LongType())])

    def summed(batches):
        pid, acc = TaskContext.get().partitionId(), 0
        for b in batches:
            w = b.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            cum = np.cumsum(w) + acc
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(w), pid, dtype=np.int32)),
                 pa.array(cum - w)], [*b.schema.names, "__pid", out])
            acc = int(cum[-1]) if len(w) else acc

    keys = [F.col(group), *order]
    done = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .mapInArrow(summed, schema), "running_sum")
    stats = done.groupBy("__pid", group).agg(F.min(out).alias("__at"),
                                             F.sum(weight).alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__pid").rowsBetween(
        Window.unboundedPreceding, -1)
    stats = stats.select("__pid", group, (F.coalesce(F.sum("__n").over(earlier), F.lit(0))
                                          - F.col("__at")).alias("__shift"))
    # one row per task and group it holds: as many as tasks plus groups
    return done.join(stats, ["__pid", group]) \
        .withColumn(out, F.col(out) + F.col("__shift")).drop("__pid", "__shift")
