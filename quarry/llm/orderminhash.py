"""Near-duplicate classes by order MinHash and banded alignment.

A text is the sequence of its 5-word shingles (words A-Z lower-cased), each
labelled with its occurrence number, so repeated shingles differ.  A sketch
band takes the ``ELL`` smallest hashes of the labelled shingles and keeps
their shingles in text order: two texts share a band when they have the same
minima in the same order, which follows their edit similarity.  Texts that
share a band are candidates; a banded alignment of the two shingle sequences
counts the shingles they have in common in order, and ``aligned / (n1 + n2 -
aligned) >= 0.8`` links them.  Classes are the connected components.

1. Equal word sequences are one node from the start, with one sketch.
2. Each bucket (band, sketch) proposes a star, all members with one
   centre, never all pairs; pairs proposed by several buckets are aligned once.
   Shingles that no other candidate text has bound every alignment from
   above, so texts that share no more than a common passage propose nothing.
3. Buckets whose star left several components are closed in blocks: a task
   holds two blocks of members, compares those in different components that
   could reach the similarity, and returns the links that join them.
4. Texts travel to the alignment by (centre, salt): a centre with many members
   is spread over tasks, each of which streams members past one centre text.

Chance of missing a pair at similarity s: (1 - s^ELL)^BANDS, 4e-5 at 0.8 for
3 and 14, if no third text links them.

Defined results: texts without words (null, empty, blank) are classes of their
own; texts of 1 to 4 words have one shingle; a null doc_id sorts last and
has a null class unless its class has another member; repeated rows share a
class; the class id is the smallest doc_id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .textscan import Texts, mix, range_hash, shingles, slices

WORDS = 5
SIMILARITY = 0.8
ELL = 3
BANDS = 14
SALT_ROWS = 64
BLOCK = 256
LAST = (1 << 63) - 1
SEED = 0x5851F42D4C957F2D


def shingle_hashes(t: Texts, k: int = WORDS):
    """(hash, labelled hash, first): the shingles of each text in order."""
    ws, we, first = t.words()
    h, sfirst = shingles(range_hash(t.raw, ws, we), first, k)
    owner = np.repeat(np.arange(t.n), np.diff(sfirst))
    order = np.lexsort((np.arange(len(h)), h, owner))
    new = np.ones(len(h), dtype=bool)
    if len(h):
        a, o = h[order], owner[order]
        new[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    label = np.empty(len(h), dtype=np.uint64)
    label[order] = mix(h[order] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, label, sfirst


def sketch(h, label, first, ell: int = ELL, bands: int = BANDS) -> np.ndarray:
    """Order MinHash of every text with a shingle: (texts, bands) hashes."""
    heads = first[:-1][np.diff(first) > 0]
    out = np.zeros((len(heads), bands), dtype=np.uint64)
    if not len(heads):
        return out
    low = np.uint64(0xFFFFFFFF)
    index = np.arange(len(h), dtype=np.uint64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(bands):
        v = (mix(label ^ np.uint64(SEED * (2 * b + 1) % (1 << 64))) & ~low) | index
        picks = np.empty((len(heads), ell), dtype=np.uint64)
        for i in range(ell):
            m = np.minimum.reduceat(v, heads)
            picks[:, i] = np.where(m == none, none, m & low)
            v[(m[m != none] & low).astype(np.int64)] = none
        picks.sort(axis=1)                       # text order; missing ones last
        acc = np.full(len(heads), b, dtype=np.uint64)
        for i in range(ell):
            there = picks[:, i] != none
            x = h[np.where(there, picks[:, i], 0).astype(np.int64)]
            acc = np.where(there, mix(acc * np.uint64(31) + x), acc)
        out[:, b] = acc
    return out


def aligned(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Length of the longest common subsequence of a and b inside the band
    that an alignment of ``need`` matches can't leave; less if there is none.

    Bit-parallel: one integer holds a row of the band, a bit per column."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[len(a) - n + head:][::-1] != b[len(b) - n + head:][::-1])
    tail = int(differ[0]) if len(differ) else n - head
    total = head + tail
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    if not len(a) or not len(b):
        return total
    # skipped elements that an alignment with enough matches may have
    skip = len(a) + len(b) - 2 * max(need - total, 0)
    if skip < 0:
        return total
    band = min(skip, max(len(a), len(b)))
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    # columns of the band at row j: lo .. lo + width - 1
    width = 2 * band + 1
    lo, v = 0, (1 << min(band + 1, len(a))) - 1
    size = min(band + 1, len(a))
    for j, y in enumerate(b.tolist()):
        new_lo = max(0, j - band)
        if new_lo > lo:
            gone = min(new_lo - lo, size)
            total += gone - (v & ((1 << gone) - 1)).bit_count()
            v >>= gone
            size -= gone
            lo = new_lo
        top = min(len(a), j + band + 1)
        if top > lo + size:
            v |= ((1 << (top - lo - size)) - 1) << size
            size = top - lo
        if size <= 0:
            break
        m = (where.get(y, 0) >> lo) & ((1 << size) - 1)
        u = v & m
        v = ((v + u) | (v - u)) & ((1 << size) - 1)
    return total + size - v.bit_count() if size > 0 else total


def similar(a, la, b, lb, similarity: float = SIMILARITY) -> bool:
    """Do shingle sequences a and b (la, lb: their sorted labelled hashes)
    align to ``similarity`` or more?"""
    both = len(a) + len(b)
    need = int(np.ceil(similarity / (1 + similarity) * both - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    # no alignment matches more than the shingles in common
    if len(np.intersect1d(la, lb, assume_unique=True)) < need:
        return False
    m = aligned(a, b, need)
    return m >= need


def _node(d: str, th: str):
    from .sharding import id_key
    return F.concat(id_key(F.col(d)), F.lpad(F.hex(th), 16, "0"))


def sketched(docs: DataFrame, ell: int, bands: int) -> DataFrame:
    """(d, th, k1, k2, n, bands): per row the digest of its word sequence and,
    where it has words, its sketch."""
    def scan(batches):
        import xxhash
        for b in slices(batches, max_bytes=2 << 20):
            t = Texts(b.column("text"), lower=True)
            ws, we, first = t.words()
            words = range_hash(t.raw, ws, we)
            h, label, sfirst = shingle_hashes(t)
            n = np.diff(sfirst)
            view = memoryview(words.tobytes())
            k = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[8 * i:8 * j]) for i, j in
                                        zip(first[:-1].tolist(), first[1:].tolist())]),
                              dtype="<i8").reshape(-1, 2)
            s = np.zeros((t.n, bands), dtype=np.uint64)
            s[n > 0] = sketch(h, label, sfirst, ell, bands)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, t.n * bands + 1, bands, dtype=np.int32)),
                                             pa.array(s.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column("d"), b.column("th"), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(n), lists],
                ["d", "th", "k1", "k2", "n", "bands"])

    return keyed(docs).select("d", "th", "text").mapInArrow(
        scan, "d long, th long, k1 long, k2 long, n long, bands array<long>")


def keyed(docs: DataFrame, row: bool = False) -> DataFrame:
    """d: doc_id with null last, th: hash of the text; together a row's text.
    ``row``: all columns, as one."""
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text",
                       *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if row else []))


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The (centre, member) pairs that align; ``texts`` has (node, text)."""
    size = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("m"))
    salted = pairs.join(size, "centre").withColumn("salt", F.pmod(
        F.xxhash64("member"), F.ceil(F.col("m") / SALT_ROWS)).cast("int")).drop("m")
    salted = materialize(salted, "near_pairs")
    rows = salted.select("centre", "salt", F.col("member").alias("node")).unionByName(
        salted.select("centre", "salt", F.col("centre").alias("node")).distinct())
    rows = rows.join(texts.select("node", "text"), "node").withColumn("rest", F.col("node") != F.col("centre")) \
        .repartition(F.col("centre"), F.col("salt")).sortWithinPartitions("centre", "salt", "rest")

    def run(batches):
        centre = None
        for b in slices(batches, max_bytes=2 << 20):
            t = Texts(b.column("text"), lower=True)
            h, label, first = shingle_hashes(t)
            hits = [], []
            for i, (c, node, rest) in enumerate(zip(*(b.column(x).to_pylist()
                                                      for x in ("centre", "node", "rest")))):
                own = h[first[i]:first[i + 1]], np.sort(label[first[i]:first[i + 1]])
                if not rest:
                    centre = own
                elif similar(*centre, *own, similarity):
                    hits[0].append(c)
                    hits[1].append(node)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.string()) for x in hits], ["a", "b"])

    return rows.mapInArrow(run, "a string, b string")


def shared_shingles(texts: DataFrame) -> DataFrame:
    """(node, private): the labelled shingles of a text that no other text of
    ``texts`` has.  They can't be aligned with anything."""
    def explode(batches):
        for b in slices(batches, max_bytes=2 << 20):
            _, label, first = shingle_hashes(Texts(b.column("text"), lower=True))
            own = np.repeat(b.column("key").to_numpy(), np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(label.view(np.int64)), pa.array(own)],
                                             ["label", "key"])

    keyed_ = texts.withColumn("key", F.xxhash64("node"))
    once = keyed_.select("text", "key").mapInArrow(explode, "label long, key long") \
        .groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).filter("n = 1")
    private = once.groupBy("key").agg(F.count(F.lit(1)).alias("private"))
    return keyed_.select("node", "key").join(private, "key", "left").select(
        "node", F.coalesce("private", F.lit(0)).alias("private"))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, ell: int = ELL,
                 bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """(d, th, node, root) for every row: its text's node and class."""
    rows = materialize(sketched(docs, ell, bands), "near_sketches")
    nodes = rows.filter("n > 0").groupBy("k1", "k2").agg(
        F.min(F.struct("d", "th")).alias("r"), F.any_value("n").alias("n"),
        F.any_value("bands").alias("bands"))
    nodes = materialize(nodes.select("k1", "k2", "r.d", "r.th", "n", "bands")
                        .withColumn("node", _node("d", "th")), "near_nodes")
    members = nodes.select("node", "n", F.posexplode("bands").alias("band", "sketch"))
    shared = members.groupBy("band", "sketch").agg(F.count(F.lit(1)).alias("c")).filter("c > 1") \
        .select("band", "sketch")
    members = materialize(members.join(materialize(shared, "near_buckets"), ["band", "sketch"]),
                          "near_members")
    # one plan at every size: what is involved grows with the input
    texts = keyed(docs).select("d", "th", "text").hint("merge").join(
        materialize(members.select("node").distinct().join(nodes, "node")
                    .select("node", "d", "th", "bands"), "near_involved"), ["d", "th"]) \
        .dropDuplicates(["node"]).select("node", "text", "bands")
    texts = materialize(texts, "near_texts")
    private = materialize(shared_shingles(texts), "near_private")
    # sharable shingles bound an alignment: a text with fewer than this share
    # of them links to none
    members = members.join(private, "node").withColumn("c", F.col("n") - F.col("private")) \
        .filter(F.col("c") >= F.lit(similarity) * F.col("n") - 1e-9)
    root = link(members.drop("private"), texts, similarity, block)
    out = rows.join(nodes.select("k1", "k2", "node"), ["k1", "k2"], "left").join(root, "node", "left")
    alone = F.col("n") == 0
    return out.select("d", "th", F.when(alone, _node("d", "th")).otherwise(F.col("node")).alias("node"),
                      F.when(alone, _node("d", "th")).otherwise(F.coalesce("root", "node")).alias("root"))


def _share(similarity: float) -> float:
    """The part of both lengths together that an alignment must reach."""
    return similarity / (1 + similarity)


def _open(members: DataFrame, root: DataFrame | None, similarity: float) -> DataFrame:
    """Members of buckets that hold several components, with their root.

    x and y can link only if c of both (their sharable shingles) is at least
    s (n of x + n of y), s = similarity / (1 + similarity); a member that no
    other one of its bucket can meet by these bounds leaves the bucket."""
    if root is None:
        members = members.withColumn("root", F.col("node"))
    else:
        members = members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    s = F.lit(_share(similarity))
    members = materialize(members, "near_rest")
    reach = members.groupBy("band", "sketch").agg(
        F.min("n").alias("least"), F.max(F.col("c") - s * F.col("n")).alias("most"))
    members = members.join(materialize(reach, "near_reach"), ["band", "sketch"]).filter(
        (F.col("c") - s * F.col("n") >= s * F.col("least") - 1e-9)
        & (F.col("most") >= s * F.col("n") - 1e-9)).drop("least", "most")
    members = materialize(members, "near_able")
    several = members.groupBy("band", "sketch").agg(F.min("root").alias("x"), F.max("root").alias("y")) \
        .filter("x != y").select("band", "sketch")
    return materialize(members.join(materialize(several, "near_several"), ["band", "sketch"]), "near_open")


def link(members: DataFrame, texts: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(node, root) of the components.

    First a star in each bucket, around the member with the fewest shingles of
    its own, which is nearest to all others: it joins most of a group of
    copies.  Then the buckets that still hold several components are closed."""
    spark = members.sparkSession
    open_ = _open(members, None, similarity)
    centre = materialize(open_.groupBy("band", "sketch").agg(
        F.min(F.struct((F.col("n") - F.col("c")).alias("own"), "node", "n", "c")).alias("at")), "near_centres")
    pairs = open_.join(centre, ["band", "sketch"]).filter(
        (F.col("node") != F.col("at.node"))
        & (F.least("c", "at.c") >= F.lit(_share(similarity)) * (F.col("n") + F.col("at.n")) - 1e-9)) \
        .select(F.col("at.node").alias("centre"), F.col("node").alias("member")).distinct()
    edges = materialize(verify(materialize(pairs, "near_candidates"), texts, similarity), "near_links")
    root = materialize(components(edges), "near_components")
    rest = open_.drop("root").join(centre.select("band", "sketch", F.col("at.node").alias("node")),
                                   ["band", "sketch", "node"], "left_anti")
    rest = _open(rest, root, similarity)
    if rest.limit(1).count() == 0:
        return root
    more = materialize(close(rest, texts, similarity, block), "near_links")
    return materialize(components(edges.unionByName(more)), "near_components")


def close(open_: DataFrame, texts: DataFrame, similarity: float, block: int) -> DataFrame:
    """The links between components that a bucket's members still have (a, b):
    enough of them to join all that link.

    A bucket is compared in blocks of about ``block`` members: a task holds
    two blocks, and only two, whatever the bucket's size, and returns links
    that join components, not pairs.  A pair that shares several buckets is
    compared in the first band it shares."""
    size = open_.groupBy("band", "sketch").agg(F.count(F.lit(1)).alias("m"))
    rows = open_.join(materialize(size, "near_open_sizes"), ["band", "sketch"]) \
        .withColumn("blocks", F.ceil(F.col("m") / block).cast("int")) \
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", "sketch", F.least("own", "t").alias("i"), F.greatest("own", "t").alias("j"),
                       "own", "node", "root", "n", "c")
    keys = ["band", "sketch", "i", "j"]
    rows = rows.join(texts, "node").repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    share = _share(similarity)

    def run(batches):
        group, held = None, []
        for b in slices(batches, max_bytes=1 << 20):
            t = Texts(b.column("text"), lower=True)
            h, label, first = shingle_hashes(t)
            cols = [b.column(x).to_pylist() for x in (*keys, "own", "node", "root", "n", "c", "bands")]
            for x, r in enumerate(zip(*cols)):
                if group != r[:4]:
                    if held:
                        yield joins(group, held)
                    group, held = r[:4], []
                seq = slice(first[x], first[x + 1])
                held.append((*r[4:], h[seq].copy(), np.sort(label[seq])))
        if held:
            yield joins(group, held)

    def joins(group, held):
        band, _, i, j = group
        held.sort(key=lambda r: (r[3] - r[4], r[1]))      # fewest shingles of its own first
        own, node, root, n, c, bands, seqs, labels = zip(*held)
        parent = {r: r for r in root}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        own, n, c, bands = (np.array(x) for x in (own, n, c, bands))
        out = [], []
        for x in range(1, len(held)):
            able = np.minimum(c[:x], c[x]) >= share * (n[:x] + n[x]) - 1e-9
            if i != j:
                able &= own[:x] != own[x]
            able &= (bands[:x] == bands[x]).argmax(axis=1) == band
            for y in np.flatnonzero(able).tolist():
                a, b = find(root[x]), find(root[y])
                if a != b and similar(seqs[x], labels[x], seqs[y], labels[y], similarity):
                    parent[a] = b
                    out[0].append(node[x])
                    out[1].append(node[y])
        return pa.RecordBatch.from_arrays([pa.array(x, type=pa.string()) for x in out], ["a", "b"])

    return rows.mapInArrow(run, "a string, b string")


def _doc_id(node: str):
    """The doc_id inside a node; null for the stand-in of a null."""
    value = F.expr(f"cast(cast(conv(substring({node}, 1, 16), 16, 10) as decimal(20, 0)) "
                   "- 9223372036854775808 as bigint)")
    return F.when(value != LAST, value)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) for every row."""
    c = near_classes(docs, **options)
    return c.select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"),
                    _doc_id("root").alias("class_id"))


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, the one with the smallest doc_id, whole."""
    c = near_classes(docs, **options)
    keep = c.filter(_node("d", "th") == F.col("root")).select("d", "th").distinct()
    whole = keyed(docs, row=True).drop("text")
    return whole.join(materialize(keep, "near_kept"), ["d", "th"]) \
        .dropDuplicates(["d", "th"]).select("row.*")
