"""Sharding by sampled splitters (law ``bytes``: shard sizes near equal).

Rows are ordered by text digest (a large group's also by doc_id).  A
size-weighted sample of these keys gives quantile boundaries that cut the
order into ranges; ranges whose exact bytes come out too full are subdivided
from a sample of their own, and a hot text is subdivided by doc_id.  Each
range is then one bounded window: running bytes inside it plus the exact
bytes of earlier ranges place every row on a line of bytes, which is cut into
shards.

Groups (equal texts) stay in one shard.  A group above 1/64 of a shard is
placed first, largest first, into the emptiest shard (there are at most
64 x shards such groups, the only rows besides the sample and one row per
range that reach the driver); it is split only where it fits no shard.  The
other groups fill the room that is left, in key order.

What the driver, a closure or a broadcast holds doesn't grow with the rows:
at most ``MAX_RANGES`` ranges (or 8 a shard) are asked for, with 32 sampled
keys each, and subdividing a range adds as many as it holds means.

Defined results: a null text is an empty one (size 1); a null doc_id sorts
first; repeated rows are separate rows of one group; an empty table gives an
empty result; other columns of the input are ignored unless named in
``payload``.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

LARGE = 64            # a group above share / LARGE is placed as a whole first
ROWS_PER_RANGE = 200_000
RANGES_PER_SHARD = 8
MAX_RANGES = 16_384   # more rows make longer ranges, which Spark sorts with spilling
SAMPLE_PER_RANGE = 32
OVERFULL = 1.5        # a range above this many times the mean is subdivided

SIGN = -(1 << 63)


def id_key(col: Column) -> Column:
    """A long as text that sorts like the number; null sorts first."""
    return F.coalesce(F.lpad(F.hex(col.bitwiseXOR(F.lit(SIGN))), 16, "0"), F.lit(""))


def keyed(docs: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    d = docs.select(F.col("doc_id").alias("__id"),
                    F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("__t"),
                    *[F.col(c).alias(f"__p_{c}") for c in payload])
    return d.withColumns({
        "__size": (F.octet_length("__t") + 1).cast("long"), "__crc": F.crc32("__t"),
        "__group": F.md5("__t")}).drop("__t")


def _sampled(rows: DataFrame, expected: float, total: int) -> list[tuple[str, float]]:
    """(key, weight): rows drawn with chance size * expected / total, about
    ``expected`` of them whatever the input's size; reruns draw the same."""
    u = F.pmod(F.xxhash64("__key", F.lit(17)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    chance = F.col("__size") * F.lit(expected / max(total, 1))
    got = rows.filter(u < chance).select(
        "__key", (F.col("__size") / F.least(chance, F.lit(1.0))).alias("w")).collect()
    return sorted((r["__key"], r["w"]) for r in got)


def quantile_keys(sample: list[tuple[str, float]], n: int) -> list[str]:
    """At most n - 1 keys that cut the sampled weight into n near equal parts."""
    if not sample or n < 2:
        return []
    cum = np.cumsum([w for _, w in sample])
    at = np.searchsorted(cum, cum[-1] * np.arange(1, n) / n)
    return sorted({sample[min(i, len(sample) - 1)][0] for i in at})


def assign_range(rows: DataFrame, splitters: list[str]) -> DataFrame:
    """Adds __range: how many splitters are at or below the row's key."""
    schema = T.StructType([*rows.schema.fields, T.StructField("__range", T.IntegerType())])

    def ranged(batches):
        for b in batches:
            r = [bisect_right(splitters, k) for k in b.column("__key").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(r, type=pa.int32())], [*b.schema.names, "__range"])

    return rows.mapInArrow(ranged, schema)


def choose_splitters(rows: DataFrame, n_ranges: int, total: int) -> list[str]:
    """Sampled quantile boundaries; overfull ranges are subdivided until none
    is left but those whose sampled keys are all the same."""
    mean = total / n_ranges
    splitters = quantile_keys(_sampled(rows, n_ranges * SAMPLE_PER_RANGE, total), n_ranges)
    whole = set()         # lower ends of ranges that a sample couldn't divide
    while True:
        ranged = assign_range(rows.select("__key", "__size"), splitters)
        full = ranged.groupBy("__range").agg(F.sum("__size").alias("b")) \
            .filter(F.col("b") > OVERFULL * mean).collect()
        over = {r["__range"]: r["b"] for r in full
                if (splitters[r["__range"] - 1] if r["__range"] else None) not in whole}
        if not over:
            return splitters
        inside = ranged.join(F.broadcast(rows.sparkSession.createDataFrame(
            [(r,) for r in over], "__range int")), "__range")
        parts = {r: int(np.ceil(b / mean)) + 1 for r, b in over.items()}
        sample: dict[int, list] = {r: [] for r in over}
        for x in _sampled(inside, SAMPLE_PER_RANGE * sum(parts.values()), sum(over.values())):
            sample[bisect_right(splitters, x[0])].append(x)
        known, new = set(splitters), set()
        for r in over:
            own = set(quantile_keys(sample[r], parts[r])) - known
            if not own:
                whole.add(splitters[r - 1] if r else None)
            new |= own
        splitters = sorted(known | new)


def place_large(groups: list[tuple[str, int]], shards: int, share: float):
    """Largest first into the emptiest shard: (pieces by group, load by shard).
    A piece (from_byte, shard) holds the group's bytes from there on."""
    load = [0.0] * shards
    pieces: dict[str, list[tuple[float, int]]] = {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        s = min(range(shards), key=lambda j: (load[j], j))
        if load[s] + size <= share * (1 + 1 / LARGE):
            pieces[key] = [(0, s)]
            load[s] += size
            continue
        done = 0.0
        pieces[key] = []
        while done < size:
            s = min(range(shards), key=lambda j: (load[j], j))
            room = max(share - load[s], share / LARGE)
            take = min(room, size - done)
            pieces[key].append((done, s))
            load[s] += take
            done += take
    return pieces, load


def shard_by_bytes(docs: DataFrame, shards: int = 16, payload: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, then payload."""
    spark = docs.sparkSession
    narrow = materialize(keyed(docs), "shard_keys")
    head = narrow.agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("b")).first()
    n, total = head["n"], head["b"] or 0
    share = total / shards
    large = [(r["__group"], r["b"]) for r in narrow.groupBy("__group").agg(
        F.sum("__size").alias("b")).filter(F.col("b") > share / LARGE).collect()]
    pieces, load = place_large(large, shards, share)
    pieces_df = spark.createDataFrame(
        [(g, [float(a) for a, _ in p], [s for _, s in p]) for g, p in pieces.items()],
        "__group string, __from array<double>, __to array<int>")

    def rows(frame: DataFrame) -> DataFrame:
        # a small group has one key; the rows of a large one have a key each
        frame = frame.join(F.broadcast(pieces_df), "__group", "left")
        big = F.col("__to").isNotNull()
        return frame.withColumns({
            "__lg": F.when(big, F.col("__group")).otherwise(F.lit("")),
            "__key": F.when(big, F.concat("__group", id_key(F.col("__id"))))
                      .otherwise(F.col("__group"))})

    n_ranges = max(shards * RANGES_PER_SHARD, min(-(-n // ROWS_PER_RANGE), MAX_RANGES))
    splitters = choose_splitters(rows(narrow), n_ranges, total)

    # exact bytes before each range: of the small groups, and of each large one
    sums = assign_range(rows(narrow), splitters).groupBy("__lg", "__range").agg(
        F.sum("__size").alias("b"))
    line = Window.partitionBy("__lg").orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1)
    before = materialize(sums.select("__lg", "__range", F.coalesce(
        F.sum("b").over(line), F.lit(0)).alias("__before")), "shard_ranges")

    # the room that large groups leave, as cuts of the small groups' line
    small_total = total - sum(b for _, b in large)
    room = np.maximum(share - np.array(load), 0)
    room = room / room.sum() if room.sum() > 0 else np.full(shards, 1 / shards)
    cuts = F.array(*[F.lit(float(x)) for x in np.cumsum(room)[:-1] * small_total],
                   F.lit(float("inf")))

    def placed(frame: DataFrame) -> DataFrame:
        frame = assign_range(rows(frame), splitters).join(
            F.broadcast(before), ["__lg", "__range"])
        by = Window.partitionBy("__range", "__lg")
        order = by.orderBy("__group", id_key(F.col("__id")), "__crc")
        frame = frame.repartition(F.col("__range")).withColumns({
            "__own": F.sum("__size").over(Window.partitionBy("__range", "__lg", "__group")),
            "__end": F.sum("__size").over(by.orderBy("__group")),  # with its peers
            "__row": F.sum("__size").over(order.rowsBetween(
                Window.unboundedPreceding, Window.currentRow))})
        mid = F.col("__before") + F.col("__end") - F.col("__own") / 2
        own = F.col("__before") + F.col("__row") - F.col("__size") / 2
        return frame.withColumn("__shard", F.when(
            F.col("__to").isNull(), F.size(F.filter(cuts, lambda c: c <= mid))).otherwise(
            F.element_at("__to", F.greatest(F.lit(1), F.size(F.filter(
                "__from", lambda c: c <= own)))))).drop("__own", "__end", "__row", "__before")

    done = materialize(placed(narrow), "shard_rows")
    # rows of the shard in earlier ranges: at most one row per range and shard
    counts = done.groupBy("__shard", "__range").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("__shard", "__range", F.coalesce(F.sum("n").over(
        Window.partitionBy("__shard").orderBy("__range").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    out = placed(keyed(docs, payload)) if payload else done
    out = out.join(F.broadcast(first), ["__shard", "__range"])
    nth = F.row_number().over(Window.partitionBy("__range", "__shard").orderBy(
        "__group", id_key(F.col("__id")), "__crc"))
    return out.select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        (F.col("__first") + nth - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"__p_{c}").alias(c) for c in payload])
