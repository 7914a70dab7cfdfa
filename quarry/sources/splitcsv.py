"""CSV files with newlines inside quoted fields, read in byte ranges.

Spark's reader gives a file that may hold such fields to one task.  Here a file
is read as lines, in splits like any text file.  A line break ends a record
exactly when the quotes before it in the file are even in number (a doubled
quote inside a field counts twice), so

1. the quotes of every split are counted, and running sums over a file's splits
   tell in which parity each split begins (one row per split);
2. each task joins its lines to records; what precedes a split's first record
   border, and a record still open at its end, come out as fragments;
3. fragments of one record -- of neighbouring splits, a few rows each -- are put
   together, and all records are parsed by ``from_csv``.

Only splits that begin inside a quoted field are told to the tasks: 16 bytes a
split.  Lines end at \\n; a \\r before it is taken off outside of quotes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE, HEAD, TAIL = 0, 1, 2     # a record, the end of an earlier one, an open one
PIECES = "file long, start long, kind int, first boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): lines with their file's hash and their split's offset."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _pieces(lines: DataFrame, quote: str) -> DataFrame:
    """The records and fragments of each split."""
    count = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    splits = lines.groupBy("file", "start").agg(F.sum(count).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = splits.withColumn("odd", F.coalesce(F.sum("n").over(before), F.lit(0)) % 2).filter("odd = 1")
    inside = lines.sparkSession.sparkContext.broadcast(
        {(r["file"], r["start"]) for r in odd.select("file", "start").collect()})

    def cut(batches):
        key, open_, held, head, first = None, False, [], False, False

        def closed(kind: int):
            return (*key, kind, first, "\n".join(held))

        for b in batches:
            out = []
            for file, start, line in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (file, start) != key:
                    if key is not None and held:
                        out.append(closed(HEAD if head else TAIL))
                    key, held = (file, start), []
                    open_ = head = key in inside.value
                    first = start == 0
                held.append(line)
                if line.count(quote) % 2:
                    open_ = not open_
                if not open_:
                    out.append(closed(HEAD if head else WHOLE))
                    held, head, first = [], False, False
            if out:
                yield _batch(out)
        if key is not None and held:
            yield _batch([closed(HEAD if head else TAIL)])

    def _batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)],
                                          [x.split()[0] for x in PIECES.split(", ")])

    return lines.mapInArrow(cut, PIECES)


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
                   quote: str = '"', **options) -> DataFrame:
    """Rows of the CSV files of ``path``; quotes inside fields are doubled.
    ``options``: further ones of ``from_csv``."""
    pieces = _pieces(_lines(spark, path), quote)
    whole = pieces.filter(F.col("kind") == WHOLE).select("first", "text")
    # a record over several splits: the open end of one, then the heads after it
    parts = pieces.filter(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", "kind")     # a split's head comes before its tail
    record = F.sum((F.col("kind") == TAIL).cast("int")).over(order)
    joined = parts.withColumn("record", record).groupBy("file", "record").agg(
        F.max("first").alias("first"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "kind", "text"))),
                                 lambda x: x["text"]), "\n").alias("text"))
    records = whole.unionByName(joined.select("first", "text"))
    if header:
        records = records.filter(~F.col("first"))
    text = F.regexp_replace("text", "\r$", "")
    row = F.from_csv(text, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields),
                     {"quote": quote, "escape": quote, "mode": "FAILFAST", "multiLine": "true", **options})
    return records.filter(F.length(text) > 0).select(row.alias("row")).select("row.*")
