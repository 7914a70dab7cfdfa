"""Ranked lexical search by the Best Position Algorithm.

1. Terms: one scan finds, in every whole text, the occurrences of the items'
   terms; a row per document keeps its length and (term, count) pairs.
2. Statistics: documents, total length and document frequencies are sums over
   those rows, combined on the map side.
3. Search: each task turns its documents, in chunks of bounded size, into one
   impact list per term: its documents by falling weight.  An item's lists are
   read from the top, side by side.  A document met in one list is looked up
   in all others (direct access), which gives its score and its position in
   every list.  A list's best position is the last one up to which every
   position has been seen, by reading or by direct access; it is never above
   the last-read position, and mostly further down.  No unseen document can
   score more than the sum of the weights at the best positions, so the search
   stops when that sum is strictly below the k-th best score; equal scores are
   read on, as ties go by doc_id.  The k-th score carries over from chunk to
   chunk of a task.
4. Merge: at most k rows per item leave a task; a window keeps the best k.

Scores are integers, so every order of work gives the same rows.  Items are
worked off in blocks whose terms take ``MAX_BYTES`` (one item at least), each
against all documents.

Defined results: a null or empty text has no term and is never found nor
counted in N; rows with the same item_id are one item with all their terms;
rows of ``documents`` with one doc_id are documents of their own; null
doc_ids come last among equal scores; an item without terms, or with none
that any document holds, has no rows; without items or documents the result
is empty; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .textscan import Texts, range_hash, slices

TOP = 50
MAX_BYTES = 32 << 20       # terms and items of a block, in each task
CHUNK = 1 << 20            # (document, term) pairs searched at once
STEP = 32                  # positions read from each list in the first round
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
BLANK = bytes(int(b < 0x80 and not chr(b).isalnum()) for b in range(256))
MATCHED = "doc_id long, n long, terms array<int>, tfs array<long>"


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""
    lowered = F.translate(F.col("text"), UPPER, UPPER.lower())
    return items.select("item_id", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), 1)).alias("term")) \
        .distinct()


def _blocks(terms: DataFrame) -> list[DataFrame]:
    """The items' terms in blocks of about ``MAX_BYTES``."""
    n_bytes = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    n = -(-n_bytes // MAX_BYTES)
    return [terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i) for i in range(n)]


class Vocabulary:
    """Sorted hashes of a block's terms; a term's number is its place."""

    def __init__(self, terms: list[str]):
        t = Texts(pa.array(terms, type=pa.string()))
        a = range_hash(t.raw, t.offs[:-1], t.offs[1:], seed=1)
        b = range_hash(t.raw, t.offs[:-1], t.offs[1:], seed=2)
        self.order = np.argsort(a)
        self.h1, self.h2 = a[self.order], b[self.order]

    def find(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which byte ranges are terms, their numbers)."""
        h = range_hash(raw, start, end, seed=1)
        at = np.minimum(np.searchsorted(self.h1, h), len(self.h1) - 1)
        hit = np.flatnonzero(self.h1[at] == h)
        same = range_hash(raw, start[hit], end[hit], seed=2) == self.h2[at[hit]]
        hit = hit[same]
        return hit, self.order[at[hit]]


def matched_terms(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term; ``vocabulary``
    is a broadcast Vocabulary."""
    def scan(batches):
        voc = vocabulary.value
        for b in slices(batches):
            t = Texts(b.column("text"), lower=True)
            start, end, first = t.words(BLANK)
            n = np.diff(first)
            hit, term = voc.find(t.raw, start, end)
            doc = np.searchsorted(first, hit, side="right") - 1
            width = len(voc.order)
            pair, tf = np.unique(doc * width + term, return_counts=True)
            offs = np.searchsorted(pair // width, np.arange(t.n + 1)).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n),
                 pa.ListArray.from_arrays(pa.array(offs), pa.array((pair % width).astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(offs), pa.array(tf.astype(np.int64)))],
                ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(scan, MATCHED)


class Lists:
    """Impact lists of a chunk of documents.

    A document's pairs are adjacent (``first``).  ``place`` is a pair's index
    in the lists, which lie one after the other: that of term t is
    ``start[t]:start[t + 1]``, with ``row`` its documents and ``impact`` their
    weights, heaviest first."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray,
                 weight: np.ndarray, n_docs: int, length: int):
        owner = np.repeat(np.arange(len(n)), sizes)
        m = 100 - 50 + (50 * n * n_docs) // max(length, 1)
        self.value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.term = term
        order = np.lexsort((owner, -self.value, term))
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.row, self.impact = owner[order], self.value[order]
        self.start = np.searchsorted(term[order], np.arange(len(weight) + 1))

    def direct(self, rows: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, list places) of the rows: their pairs of the wanted terms."""
        size = self.first[rows + 1] - self.first[rows]
        ends = np.cumsum(size)
        pair = np.arange(int(size.sum())) + np.repeat(self.first[rows] - (ends - size), size)
        own = wanted[self.term[pair]]
        which = np.repeat(np.arange(len(rows)), size)[own]
        pair = pair[own]
        score = np.zeros(len(rows), dtype=np.int64)
        np.add.at(score, which, self.value[pair])
        return score, self.place[pair]


def best_positions(lists: Lists, terms: np.ndarray, k: int, floor: int, step: int = STEP):
    """(rows, scores, positions read): a set that holds every row of the chunk
    scoring above 0 that can be among the best k; ``floor`` is a score that
    the k-th best is known to reach (0: none known)."""
    heads, ends = lists.start[terms], lists.start[terms + 1]
    alive = heads < ends
    terms, heads, ends = terms[alive], heads[alive], ends[alive]
    wanted = np.zeros(len(lists.start) - 1, dtype=bool)
    wanted[terms] = True
    seen_place = np.zeros(len(lists.row), dtype=bool)
    seen_row = np.zeros(len(lists.first) - 1, dtype=bool)
    best = heads.copy()                     # first unseen place of each list
    rows, scores = [], []
    depth, read, kth = 0, 0, floor
    while len(heads) and depth < int((ends - heads).max()):
        lo, hi = np.minimum(heads + depth, ends), np.minimum(heads + depth + step, ends)
        met = np.concatenate([lists.row[a:z] for a, z in zip(lo, hi) if a < z])
        read += len(met)
        depth, step = depth + step, step * 2
        new = np.unique(met[~seen_row[met]])
        if len(new):
            seen_row[new] = True
            score, places = lists.direct(new, wanted)
            seen_place[places] = True
            rows.append(new)
            scores.append(score)
            everything = np.concatenate(scores)
            if len(everything) >= k:
                kth = max(kth, int(np.partition(everything, len(everything) - k)[len(everything) - k]))
        bound = 0
        for j, z in enumerate(ends):
            a = best[j]
            gap = seen_place[a:z]
            best[j] = a = z if gap.all() else a + int(gap.argmin())
            if a > heads[j]:
                # the weight at the best position; of an exhausted list no
                # document is unseen
                bound += int(lists.impact[a - 1]) if a < z else 0
        if depth and bound < kth and (best > heads).all():
            break
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), read
    row, score = np.concatenate(rows), np.concatenate(scores)
    good = score > 0
    return row[good], score[good], read


class Best:
    """The best k rows of each item that a task has met so far."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.top = [None] * n_items

    def floor(self, item: int) -> int:
        kept = self.top[item]
        return int(kept[0][-1]) if kept is not None and len(kept[0]) == self.k else 0

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        if self.top[item] is not None:
            score, doc, null = (np.concatenate(x) for x in zip(self.top[item], (score, doc, null)))
        order = np.lexsort((doc, null, -score))[:self.k]
        self.top[item] = score[order], doc[order], null[order]

    def batch(self, ids: list) -> pa.RecordBatch:
        got = [(i, x) for i, x in enumerate(self.top) if x is not None]
        score, doc, null = (np.concatenate([x[j] for _, x in got]) if got else np.zeros(0, dtype=kind)
                            for j, kind in enumerate((np.int64, np.int64, bool)))
        item = pa.array([ids[i] for i, x in got for _ in range(len(x[0]))], type=pa.int64())
        return pa.RecordBatch.from_arrays(
            [item, pa.array(doc, mask=null), pa.array(score)], ["item_id", "doc_id", "score"])


def _chunks(batches, size: int):
    """Documents as (doc_id, null, n, pairs per document, term, tf) with about
    ``size`` pairs."""
    held, pairs = [], 0

    def merged():
        return tuple(np.concatenate(x) for x in zip(*held))

    for b in batches:
        doc, lists = b.column("doc_id"), b.column("terms")
        null = doc.is_null().to_numpy(zero_copy_only=False)
        held.append((doc.fill_null(0).to_numpy(zero_copy_only=False), null,
                     b.column("n").to_numpy(zero_copy_only=False),
                     lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
                     lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                     b.column("tfs").flatten().to_numpy(zero_copy_only=False)))
        pairs += len(held[-1][4])
        if pairs >= size:
            yield merged()
            held, pairs = [], 0
    if held:
        yield merged()


def search_block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score): per task the best k rows of each item."""
    spark = docs.sparkSession
    none = spark.createDataFrame([], "item_id long, doc_id long, score long")
    rows = terms.toArrow()                       # a block: bounded bytes
    if not rows.num_rows:
        return none
    coded = rows.column("term").combine_chunks().dictionary_encode()
    item = rows.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
    ids = item.dictionary.to_pylist()
    owner, code = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (item, coded))
    order = np.lexsort((code, owner))
    needs = np.split(code[order], np.searchsorted(owner[order], np.arange(1, len(ids))))
    names = coded.dictionary.to_pylist()
    found = materialize(matched_terms(docs, spark.sparkContext.broadcast(Vocabulary(names))),
                        "matched_terms")
    total = found.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    if not total["n"]:
        return none
    weights = found.select(F.explode("terms").alias("term")).groupBy("term") \
        .agg(F.count(F.lit(1)).alias("df")) \
        .select("term", F.floor(1000 * F.log(F.lit(2 * total["n"] + 2) / (2 * F.col("df") + 1)))
                .cast("long").alias("w")).toArrow()     # at most the block's terms
    weight = np.zeros(len(names), dtype=np.int64)
    weight[weights.column("term").to_numpy()] = weights.column("w").to_numpy()
    needs = [x[weight[x] > 0] for x in needs]    # a weight of 0 adds to no score
    shared = spark.sparkContext.broadcast((ids, needs, weight, total["n"], total["l"]))

    def search(batches):
        ids, needs, weight, n_docs, length = shared.value
        best = Best(len(ids), k)
        for doc, null, n, sizes, term, tf in _chunks(batches, CHUNK):
            lists = Lists(n, sizes, term, tf, weight, n_docs, length)
            for i, own in enumerate(needs):
                row, score, _ = best_positions(lists, own, k, best.floor(i))
                if len(row):
                    best.add(i, score, doc[row], null[row])
        yield best.batch(ids)

    return found.mapInArrow(search, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the best k documents of each item."""
    terms = materialize(item_terms(items), "item_terms")
    out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for block in _blocks(terms):
        out = out.unionByName(search_block(docs, block, k))
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("item_id", "rank", "doc_id", "score")
