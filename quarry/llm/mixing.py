"""Mixing sources to target weights by blocks of words.

Each source's documents, in doc_id order, are one stream of words, packed
into blocks of ``block_words``.  The mix is a sequence of slots in output
shards: a shard draws how many of its slots each source gets (multinomial,
seeded by shard), a running sum over shards turns the draws into slot numbers
0, 1, 2, ... of each source, and slot k holds block p(k mod blocks), where p
is a pseudorandom permutation of the source's block indices, another one in
each pass.  So a source is read once in full before any of it is read again.
Slots and blocks meet in a join on (source, block index).

A source gets exactly the slots that its target takes: draws beyond that are
cut, the missing ones go to one last shard, and the last slot takes only the
words still missing.  What a document gives is the sum over its blocks.

The prefix sums behind the streams are range-partitioned, so a source with a
third of all rows spans many tasks.  One row per source reaches the driver
(sources are a small dimension, at most ``MAX_SOURCES``).

Defined results: a null text has size 0; null is a source of its own, the
last one; null doc_ids come first in a stream; repeated rows are separate
rows; rows of size 0 take 0; an empty table gives an empty result; other
columns are ignored unless ``mixed_documents`` returns them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .prefix import running_sum
from .textscan import WORD, Texts, mix, slices

WEIGHTS = (3, 1, 2)
RATIO = 1.5
MAX_REPEAT = 2
BLOCK_WORDS = 1024
SLOTS_PER_SHARD = 4096
SEED = 20240229
MAX_SOURCES = 1_000_000


def water_fill(sizes: list[int], weights: list[float], total: float,
               max_repeat: float = MAX_REPEAT) -> list[float]:
    """Shares of ``total`` by weight, none above max_repeat x its size; what
    is cut off is shared again among the others until none is above."""
    capped: dict[int, float] = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(capped.values())
        w = sum(weights[i] for i in free)
        share = {i: rest * weights[i] / w for i in free} if w else {}
        over = [i for i in free if share[i] > max_repeat * sizes[i]]
        if not over:
            return [capped.get(i, share.get(i, 0.0)) for i in range(len(sizes))]
        capped.update({i: float(max_repeat * sizes[i]) for i in over})


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 (n, key: per element): a Feistel
    network on the next power of four, walked on until it lands inside."""
    k = k.astype(np.uint64)
    n = np.broadcast_to(n, k.shape).astype(np.uint64)
    key = np.broadcast_to(key, k.shape).astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2)) \
        .astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.copy(), np.arange(len(k))
    while len(todo):
        x, h, m, s = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(4):
            left, right = right, left ^ (mix(right + s + np.uint64(r) * np.uint64(0x9E3779B9)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _pass_key(src: np.ndarray, pass_: np.ndarray) -> np.ndarray:
    return mix(np.uint64(SEED) + src.astype(np.uint64) * np.uint64(1 << 20)
               + pass_.astype(np.uint64))


@dataclass
class Plan:
    """Per source (by index): names, words, blocks, target, slots, and how
    many words the last slot takes (0: the whole block)."""
    names: list
    words: np.ndarray
    blocks: np.ndarray
    target: np.ndarray
    slots: np.ndarray
    last: np.ndarray
    block_words: int


def plan_sources(sums: list[tuple[str | None, int]], ratio=RATIO, weights=WEIGHTS,
                 max_repeat=MAX_REPEAT, block_words=BLOCK_WORDS) -> Plan:
    # Python orders str by code point
    sums = sorted(sums, key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [int(s) for _, s in sums]
    target = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sums))],
                        ratio * sum(sizes), max_repeat)
    words = np.array(sizes, dtype=np.int64)
    blocks = -(-words // block_words)
    slots = np.zeros(len(sums), dtype=np.int64)
    last = np.zeros(len(sums), dtype=np.int64)
    for i, (n, b, t) in enumerate(zip(words, blocks, target)):
        if n == 0:
            continue
        take = min(round(t), max_repeat * int(n))
        passes, rest = divmod(take, int(n))
        slots[i] = passes * b
        if rest:
            need = -(-rest // block_words)
            got = need * block_words
            # the source's short last block may be among them
            tail = int(n) - (int(b) - 1) * block_words
            order = permute(np.arange(min(need + 1, b)), b, _pass_key(np.array([i]), np.array([passes])))
            size = np.where(order == b - 1, tail, block_words)
            cum = np.cumsum(size)
            k = int(np.searchsorted(cum, rest)) + 1
            slots[i] += k
            last[i] = rest - (int(cum[k - 2]) if k > 1 else 0)
    return Plan([s for s, _ in sums], words, blocks, np.array(target), slots, last, block_words)


def draw_slots(spark: SparkSession, plan: Plan, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """(shard, src, block, pass, words): every slot of the mix."""
    total = int(plan.slots.sum())
    schema = "shard int, src int, block long, pass int, words int"
    if not total:
        return spark.createDataFrame([], schema)
    n_shards = -(-total // slots_per_shard)
    p = plan.slots / total

    def drawn(batches):
        for b in batches:
            for shard in b.column("id").to_pylist():
                n = min(slots_per_shard, total - shard * slots_per_shard)
                c = np.random.default_rng([SEED, shard]).multinomial(n, p)
                src = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(src), shard, dtype=np.int32)),
                     pa.array(src.astype(np.int32)), pa.array(c[src].astype(np.int64))],
                    ["shard", "src", "n"])

    draws = materialize(spark.range(n_shards).mapInArrow(drawn, "shard int, src int, n long"),
                        "mix_draws")
    earlier = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    draws = draws.withColumn("k0", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # what a source draws too little goes to one more shard
    quota = spark.createDataFrame([(i, int(s)) for i, s in enumerate(plan.slots)], "src int, q long")
    rest = F.broadcast(quota).join(draws.groupBy("src").agg(F.sum("n").alias("k0")), "src", "left") \
        .select(F.lit(n_shards).alias("shard"), "src", (F.col("q") - F.coalesce("k0", F.lit(0))).alias("n"),
                F.coalesce("k0", F.lit(0)).alias("k0")).filter("n > 0")
    slots, last, blocks = plan.slots, plan.last, plan.blocks
    block_words, words = plan.block_words, plan.words

    def expand(batches):
        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("shard", "src", "k0", "n")]
            for shard, src, k0, n in zip(*cols):
                n = min(int(n), int(slots[src]) - int(k0))
                for lo in range(0, max(n, 0), 1 << 20):
                    k = int(k0) + np.arange(lo, min(n, lo + (1 << 20)), dtype=np.int64)
                    s = np.full(len(k), src)
                    pass_ = k // blocks[src]
                    block = permute(k % blocks[src], blocks[src], _pass_key(s, pass_))
                    w = np.minimum(block_words, words[src] - block * block_words)
                    if last[src]:
                        w = np.where(k == slots[src] - 1, last[src], w)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k), shard, dtype=np.int32)),
                         pa.array(s.astype(np.int32)), pa.array(block),
                         pa.array(pass_.astype(np.int32)), pa.array(w.astype(np.int32))],
                        ["shard", "src", "block", "pass", "words"])

    every = draws.select("shard", "src", "n", "k0").unionByName(rest)
    return every.mapInArrow(expand, schema)


def _streams(docs: DataFrame, keep: tuple[str, ...], block_words: int, **options):
    """(rows with their place in the source's stream, plan)."""
    rows = docs.select("doc_id", "source", *keep, F.coalesce(
        F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("__tie"))
    if keep:
        narrow = rows.select("source", "size")
    else:
        rows = narrow = materialize(rows, "mix_rows")
    sums = [(r["source"], r["s"]) for r in narrow.groupBy("source").agg(
        F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()]
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    plan = plan_sources(sums, block_words=block_words, **options)
    names = docs.sparkSession.createDataFrame(
        [(n, i, int(w), float(t)) for i, (n, w, t) in enumerate(zip(plan.names, plan.words, plan.target))],
        "source string, src int, source_size long, target double")
    # one row per source, already on the driver
    rows = rows.withColumnRenamed("source", "__source").join(
        F.broadcast(names.withColumnRenamed("source", "__name")),
        F.col("__source").eqNullSafe(F.col("__name"))).drop("__name")
    return running_sum(rows, "src", [F.col("doc_id").asc_nulls_first(), F.col("__tie")], "size"), plan


def _pieces(rows: DataFrame, block_words: int) -> DataFrame:
    """(src, before, block, lo, hi): the part of each block a document has."""
    return rows.filter("size > 0").select("src", "before", "size", F.explode(F.sequence(
        F.floor(F.col("before") / block_words),
        F.floor((F.col("before") + F.col("size") - 1) / block_words))).alias("block")).select(
        "src", "before", "block",
        F.greatest(F.lit(0), F.col("before") - F.col("block") * block_words).alias("lo"),
        F.least(F.lit(block_words), F.col("before") + F.col("size")
                - F.col("block") * block_words).alias("hi"))


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS,
                slots_per_shard: int = SLOTS_PER_SHARD, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, source."""
    rows, plan = _streams(docs, (), block_words, **options)
    slots = draw_slots(docs.sparkSession, plan, slots_per_shard)
    got = _pieces(rows, block_words).join(slots.select("src", "block", "words"), ["src", "block"]) \
        .groupBy("src", "before").agg(F.sum(F.greatest(
            F.lit(0), F.least("hi", "words") - F.col("lo"))).alias("taken"))
    # an empty document shares its place with the next one and takes nothing
    out = rows.withColumn("__at", F.when(F.col("size") > 0, F.col("before"))).join(
        got.withColumnRenamed("before", "__at"), ["src", "__at"], "left")
    return out.select("doc_id", "size", "source_size", "target",
                      F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                      F.col("__source").alias("source"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS,
                    slots_per_shard: int = SLOTS_PER_SHARD, **options) -> DataFrame:
    """The mix as documents: for every document and pass that takes words of
    it one row, with the columns of ``docs`` (doc_id, text, lang, source,
    n_chars); the text is what is taken, runs joined by \\n."""
    rows, plan = _streams(docs, ("text", "lang"), block_words, **options)
    slots = draw_slots(docs.sparkSession, plan, slots_per_shard)
    hit = _pieces(rows.select("src", "before", "size"), block_words).join(
        slots.select("src", "block", "pass", "words"), ["src", "block"]) \
        .filter(F.least("hi", "words") > F.col("lo"))
    runs = hit.groupBy("src", F.col("before").alias("__at")).agg(F.array_sort(F.collect_list(F.struct(
        "pass", (F.col("block") * block_words + F.col("lo") - F.col("before")).alias("a"),
        (F.col("block") * block_words + F.least("hi", "words") - F.col("before")).alias("z")))).alias("runs"))
    full = rows.filter("size > 0").withColumnRenamed("before", "__at").join(runs, ["src", "__at"]) \
        .select("doc_id", "text", "lang", F.col("__source").alias("source"),
                "runs.pass", "runs.a", "runs.z")

    def cut(batches):
        for b in slices(batches):
            t = Texts(b.column("text"))
            start, end, first = t.words()
            rows_, texts = [], []
            for i, (ps, as_, zs) in enumerate(zip(*(b.column(c).to_pylist() for c in ("pass", "a", "z")))):
                for p in sorted(set(ps)):
                    merged = []
                    for a, z in sorted((a, z) for q, a, z in zip(ps, as_, zs) if q == p):
                        if merged and merged[-1][1] == a:
                            merged[-1][1] = z
                        else:
                            merged.append([a, z])
                    f = first[i]
                    rows_.append(i)
                    texts.append(b"\n".join(t.raw[start[f + a]:end[f + z - 1]] for a, z in merged)
                                 .decode("utf-8"))
            at = pa.array(rows_, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(at), pa.array(texts, type=pa.string()),
                 b.column("lang").take(at), b.column("source").take(at),
                 pa.array([len(x) for x in texts], type=pa.int64())],
                ["doc_id", "text", "lang", "source", "n_chars"])

    return full.mapInArrow(cut, "doc_id long, text string, lang string, source string, n_chars long")
