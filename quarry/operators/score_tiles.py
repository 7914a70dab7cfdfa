"""Scores of all queries against all documents, in tiles inside the documents' tasks.

A join of query terms with postings makes a row per (query term, posting) and a
group per (query, document): for a task with thousands of queries that is far
more than the tables themselves.  Here the postings of query terms cross one
exchange, to their document's task, and a task scores ``TILE_QUERIES`` queries
against ``TILE_DOCS`` documents at a time: terms that many of both have by a
matrix product, the others by their pairs.  What leaves the task is what is asked
for: the rows of the run, each query's best k, or how many documents come before
the judged ones.

Queries are sent to the tasks in blocks of at most ``max_bytes``, one after the
other, so neither the driver nor a task holds more, however many there are.  Where
there are several, terms are numbered and postings brought to their document's
task once: a stored row a document, which each block reads without a join, an
exchange or a sort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BROADCAST_MAX_BYTES
from ..session import materialize
from .impact import SCHEMA, SLACK, _chunks, _kth, _ranges
from .ordering import dense_index
from .ranking import top_k_per_query
from .vector_index import _best

TILE_QUERIES = 512
TILE_DOCS = 2048
CHUNK = 1 << 18            # postings held at once
SLAB = 1024                # terms of one matrix product
DENSE = 256                # a product is as fast for this many cells as one pair of a rare term
PAIRS = 1 << 21            # pairs of rare terms added at once
CELLS_PER_TASK = 4_000_000
CELLS_PER_STORED_TASK = 1 << 28
WAVES = 3                  # of tasks over stored documents at least
PACK = 1 << 20             # stored postings held at once
HELD = 1 << 18             # candidates held before the best are taken
ENTRY_BYTES = 24           # of a query's term in a block
MAX_TASKS = 20_000
LEAST_QUERIES = 16         # of a block, whatever their size


class QueryBlock:
    """Query terms in the order (tile of queries, term)."""

    def __init__(self, query_id, code, weight):
        self.ids, owner = np.unique(query_id, return_inverse=True)
        tile = owner // TILE_QUERIES
        order = np.lexsort((owner, code, tile))
        self.code, self.weight, self.row = code[order], weight[order], (owner % TILE_QUERIES)[order]
        self.first = np.searchsorted(tile[order], np.arange(-(-len(self.ids) // TILE_QUERIES) + 1))
        self.positive = bool((weight > 0).all())
        self.sides = None

    @classmethod
    def of(cls, parts: dict) -> QueryBlock:
        """A block from the ``vars`` of one, as they are sent to the tasks."""
        block = cls.__new__(cls)
        vars(block).update(parts)
        return block

    def side(self, t: int) -> _Side:
        """The queries of a tile, made once."""
        if self.sides is None:
            self.sides = {}
        if t not in self.sides:
            e = slice(self.first[t], self.first[t + 1])
            self.sides[t] = _Side(self.code[e], self.row[e], self.weight[e],
                                  min(len(self.ids) - t * TILE_QUERIES, TILE_QUERIES))
        return self.sides[t]

    def pair_scores(self, query_id, pair_doc, doc_id, code, weight, width: int) -> np.ndarray:
        """Scores of the pairs with postings whose rows of a document are adjacent;
        sums over a query's terms, in the documents here."""
        head = np.ones(len(doc_id), dtype=bool)
        head[1:] = doc_id[1:] != doc_id[:-1]
        ids, first = doc_id[head], np.append(np.flatnonzero(head), len(doc_id))
        order = np.argsort(ids)
        at = order[np.minimum(np.searchsorted(ids, pair_doc, sorter=order), len(ids) - 1)]
        here = np.flatnonzero(ids[at] == pair_doc)
        out, dense, last = np.zeros(len(query_id)), np.zeros(width), -1
        own = np.zeros(0, dtype=np.int64)
        for x in here[np.argsort(query_id[here], kind="stable")].tolist():
            i = int(np.searchsorted(self.ids, query_id[x]))
            if i == len(self.ids) or self.ids[i] != query_id[x]:
                continue
            if i != last:
                dense[own] = 0
                q = self.side(i // TILE_QUERIES)
                mine = np.flatnonzero(q.place == i % TILE_QUERIES)
                own, last = q.code[mine], i
                np.add.at(dense, own, q.weight[mine])
            part = slice(first[at[x]], first[at[x] + 1])
            out[x] = dense[code[part]] @ weight[part]
        return out

    def tiles(self, doc_id, code, weight):
        """(slice of queries, doc ids, scores, whether a term is shared) over
        postings whose rows of a document are adjacent."""
        head = np.ones(len(doc_id), dtype=bool)
        head[1:] = doc_id[1:] != doc_id[:-1]
        ids, own = doc_id[head], np.cumsum(head) - 1
        first = np.append(np.flatnonzero(head), len(doc_id))
        for lo in range(0, len(ids), TILE_DOCS):
            hi = min(lo + TILE_DOCS, len(ids))
            part = slice(first[lo], first[hi])
            order = np.argsort(code[part], kind="stable")
            d = _Side(code[part][order], own[part][order] - lo, weight[part][order], hi - lo)
            for t in range(len(self.first) - 1):
                a, q = t * TILE_QUERIES, self.side(t)
                score = _product(q, d)
                hit = score != 0 if self.positive and (d.weight > 0).all() else _product(q.ones(), d.ones()) > 0
                yield slice(a, a + q.size), ids[lo:hi], score, hit


class _Side:
    """(code, place, weight) of the entries of one side of a tile, by code."""

    def __init__(self, code, place, weight, size: int):
        self.code, self.place, self.weight, self.size = code, place, weight, size
        head = np.ones(len(code), dtype=bool)
        head[1:] = code[1:] != code[:-1]
        self.terms = code[head]
        self.first = np.append(np.flatnonzero(head), len(code))

    def ones(self) -> _Side:
        return _Side(self.code, self.place, np.ones(len(self.code)), self.size)

    def matrix(self, terms) -> np.ndarray:
        """terms x places; entries of one cell are added up."""
        lo, hi = self.first[terms], self.first[terms + 1]
        at = _ranges(lo, hi)
        cell = np.repeat(np.arange(len(terms)), hi - lo) * self.size + self.place[at]
        return np.bincount(cell, weights=self.weight[at], minlength=len(terms) * self.size) \
            .reshape(len(terms), self.size)


def _product(q: _Side, d: _Side) -> np.ndarray:
    """Summed weight products of each query and document of a tile."""
    out = np.zeros((q.size, d.size))
    _, tq, td = np.intersect1d(q.terms, d.terms, assume_unique=True, return_indices=True)
    nq, nd = q.first[tq + 1] - q.first[tq], d.first[td + 1] - d.first[td]
    many = nq * nd * DENSE > out.size
    for lo in range(0, int(many.sum()), SLAB):
        out += q.matrix(tq[many][lo:lo + SLAB]).T @ d.matrix(td[many][lo:lo + SLAB])
    tq, td, nq, nd = tq[~many], td[~many], nq[~many], nd[~many]
    # a query's entry of a rare term meets the documents of that term
    entry, term = _ranges(q.first[tq], q.first[tq + 1]), np.repeat(td, nq)
    n = np.repeat(nd, nq)
    end = np.cumsum(n)
    lo = 0
    while lo < len(entry):
        hi = max(int(np.searchsorted(end, end[lo] - n[lo] + PAIRS, side="right")), lo + 1)
        e, t, size = entry[lo:hi], term[lo:hi], n[lo:hi]
        at = _ranges(d.first[t], d.first[t + 1])
        out += np.bincount(np.repeat(q.place[e], size) * d.size + d.place[at],
                           weights=np.repeat(q.weight[e], size) * d.weight[at], minlength=out.size).reshape(out.shape)
        lo = hi
    return out


class Scorer:
    """postings(doc_id, term, wd) and query terms(query_id, term, wq); the score
    of a query and a document is their summed wq * wd.  Both are read more than
    once, so they should be stored tables."""

    def __init__(self, postings: DataFrame, query_terms: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES):
        self.postings = postings.select("doc_id", "term", F.col("wd").cast("double").alias("wd"))
        self.query_terms = query_terms.select("query_id", "term", F.col("wq").cast("double").alias("wq"))
        self.max_bytes = max_bytes
        self._docs = self._blocks = self._coded = None

    def fits(self) -> bool:
        """Whether ids are whole numbers and none is null, as the tiles need it."""
        if {dict(self.postings.dtypes)["doc_id"], dict(self.query_terms.dtypes)["query_id"]} != {"bigint"}:
            return False
        none = F.coalesce(F.max(F.col("doc_id").isNull()), F.lit(False))
        docs, null = self.postings.agg(F.approx_count_distinct("doc_id"), none).first()
        self._docs = docs
        return not null and not self.query_terms.filter(F.col("query_id").isNull()).limit(1).count()

    def block_count(self) -> int:
        if self._blocks is None:
            n, queries = self.query_terms.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
            self._blocks = max(min(-(-n * ENTRY_BYTES // max(self.max_bytes, 1)), -(-queries // LEAST_QUERIES)), 1)
        return self._blocks

    def block(self, df: DataFrame, k: int, n: int) -> DataFrame:
        """The rows of ``df`` whose query is in the k-th of n blocks."""
        return df.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) if n > 1 else df

    def _docs_count(self) -> int:
        if self._docs is None:
            self._docs = self.postings.agg(F.approx_count_distinct("doc_id")).first()[0]
        return self._docs

    def _stored(self) -> tuple[DataFrame, DataFrame, int]:
        """(query_id, code, wq), (doc_id, codes, weights) and the number of codes:
        both sides with numbered terms, a document's postings in one row."""
        if self._coded is None:
            from .lexical import bytes_at_most
            spark = self.postings.sparkSession
            codes = materialize(dense_index(self.query_terms.select("term").filter("term is not null").distinct(),
                                            ["term"], "code"), "term_codes")
            side = F.broadcast(codes) if bytes_at_most(codes, self.max_bytes) else codes
            queries = materialize(self.query_terms.join(side, "term").select("query_id", "code", "wq"), "coded_queries")
            tasks = -(-self._docs_count() * queries.select(F.count_distinct("query_id")).first()[0]
                      // CELLS_PER_STORED_TASK)
            tasks = min(max(tasks, WAVES * spark.sparkContext.defaultParallelism), MAX_TASKS)
            docs = self.postings.join(side, "term").select("doc_id", "code", "wd") \
                .repartition(tasks, "doc_id").sortWithinPartitions("doc_id") \
                .mapInArrow(_packed, "doc_id long, codes binary, weights binary")
            self._coded = queries, materialize(docs, "coded_postings"), codes.count()
        return self._coded

    def map_tiles(self, k: int, n: int, work, schema: str) -> DataFrame:
        """``work(query ids, tiles)`` over the documents of each task; ``tiles``
        yields (slice of queries, doc ids, scores, whether a term is shared)."""
        if n > 1:
            queries, docs, _ = self._stored()
            q = self.block(queries, k, n).toArrow()
            return self._mapped(docs, q, q.column("code").to_numpy(), _unpacked, work, schema)
        spark = self.postings.sparkSession
        q = self.query_terms.toArrow()
        coded = q.column("term").combine_chunks().dictionary_encode()
        words = coded.dictionary.cast(pa.string())
        terms = spark.createDataFrame(pa.table({"term": words, "code": pa.array(np.arange(len(words)))})) \
            if len(words) else spark.createDataFrame([], "term string, code long")
        tasks = -(-self._docs_count() * len(np.unique(q.column("query_id").to_numpy())) // CELLS_PER_TASK)
        tasks = min(max(tasks, spark.sparkContext.defaultParallelism), MAX_TASKS)
        mine = self.postings.join(F.broadcast(terms), "term").select("doc_id", "code", "wd") \
            .repartition(tasks, "doc_id").sortWithinPartitions("doc_id")
        return self._mapped(mine, q, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
                            lambda batches: _chunks(batches, CHUNK), work, schema)

    def _mapped(self, docs: DataFrame, q: pa.Table, code, read, work, schema: str) -> DataFrame:
        block = vars(QueryBlock(q.column("query_id").to_numpy(), code, q.column("wq").to_numpy()))
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches):
            b = QueryBlock.of(shared.value)
            yield from work(b.ids, (tile for part in read(batches) for tile in b.tiles(*part)))

        return docs.mapInArrow(search, schema)

    def _by_block(self, work, schema: str, after=lambda df: df) -> DataFrame:
        """``work`` for all blocks; several are stored one after the other."""
        n = self.block_count()
        out = None
        for k in range(n):
            part = after(self.map_tiles(k, n, work, schema))
            if n > 1:
                part = materialize(part, "query_block")
            out = part if out is None else out.unionByName(part)
        return out

    def run(self) -> DataFrame:
        """(query_id, doc_id, score): every document sharing a term; stored, where
        the queries are several blocks."""
        def rows(ids, tiles):
            for q, docs, score, hit in tiles:
                i, j = np.nonzero(hit)
                yield _batch(ids[q][i], docs[j], score[i, j])

        return self._by_block(rows, SCHEMA)

    def top(self, k: int) -> DataFrame:
        """The top-k run with rank."""
        def best(ids, tiles):
            floor = np.full(len(ids), -np.inf)         # a score that k documents of the task reach
            held, n = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))], 0
            for q, docs, score, hit in tiles:
                low = floor[q] - np.where(np.isfinite(floor[q]), np.abs(floor[q]), 0) * SLACK
                near = hit & (score >= low[:, None])
                for i in np.flatnonzero(near.any(axis=1)):
                    kth = _kth(score[i, near[i]], k)
                    if kth > floor[q.start + i]:
                        floor[q.start + i] = kth
                        near[i] &= score[i] >= kth - abs(kth) * SLACK
                i, j = np.nonzero(near)
                held.append((ids[q][i], docs[j], score[i, j]))
                n += len(i)
                if n > max(HELD, 4 * k * len(ids)):
                    held = [_best(*(np.concatenate(x) for x in zip(*held)), k)]
                    n = len(held[0][0])
                    _raise(floor, ids, held[0], k)
            yield _batch(*_best(*(np.concatenate(x) for x in zip(*held)), k))      # k rows a query at most

        return self._by_block(best, SCHEMA, lambda df: top_k_per_query(df, k))

    def pair_scores(self, pairs: DataFrame, k: int = 0, n: int = 1) -> DataFrame:
        """(query_id, doc_id, score) of given distinct pairs, whose queries are in
        the k-th of n blocks; 0 where no term is shared.  Of several blocks, the
        pairs are sent to the tasks that hold the documents."""
        if n > 1:
            got = self._pair_scores_of_block(pairs, k, n)
        else:
            t = pairs.select("query_id", "doc_id").join(self.query_terms, "query_id")
            got = t.join(self.postings, ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(
                F.sum(F.col("wq") * F.col("wd")).alias("score"))
        return pairs.join(got, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))

    def _pair_scores_of_block(self, pairs: DataFrame, k: int, n: int) -> DataFrame:
        queries, docs, width = self._stored()
        q, p = self.block(queries, k, n).toArrow(), pairs.select("query_id", "doc_id").toArrow()
        block = vars(QueryBlock(q.column("query_id").to_numpy(), q.column("code").to_numpy(), q.column("wq").to_numpy()))
        shared = docs.sparkSession.sparkContext.broadcast(
            (block, p.column("query_id").to_numpy(), p.column("doc_id").to_numpy()))

        def score(batches):
            parts, query_id, doc_id = shared.value
            b = QueryBlock.of(parts)
            for part in _unpacked(batches):
                some = np.flatnonzero(np.isin(doc_id, part[0]))
                yield _batch(query_id[some], doc_id[some], b.pair_scores(query_id[some], doc_id[some], *part, width))

        return docs.mapInArrow(score, SCHEMA)


def _raise(floor, ids, best, k: int) -> None:
    """Floors of the queries from their best rows, a query's by falling score."""
    q, _, score = best
    head = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(head, len(q)))
    whole = head[size == k]
    at = np.searchsorted(ids, q[whole])
    floor[at] = np.maximum(floor[at], score[whole + k - 1])


def _packed(batches):
    """Rows (doc_id, code, weight), a document's adjacent, as a row a document."""
    for doc, code, weight in _chunks(batches, CHUNK):
        head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        first = np.append(head, len(doc))

        def cells(x):
            offsets = pa.py_buffer((first * x.itemsize).astype(np.int32).tobytes())
            return pa.Array.from_buffers(pa.binary(), len(head), [None, offsets, pa.py_buffer(x.tobytes())])

        yield pa.RecordBatch.from_arrays([pa.array(doc[head]), cells(code.astype(np.int64)), cells(weight)],
                                         ["doc_id", "codes", "weights"])


def _numbers(cells: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of binary cells, where each cell's begin)."""
    cells = cells.cast(pa.large_binary())
    first = np.frombuffer(cells.buffers()[1], dtype=np.int64)[cells.offset:cells.offset + len(cells) + 1]
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(cells.buffers()[2], dtype=np.uint8)[first[0]:first[-1]].copy().view(kind)
    return flat, (first - first[0]) // size


def _unpacked(batches):
    """(doc_id, code, weight) of whole documents, about ``PACK`` postings or a
    tile's documents."""
    held, n, docs = [], 0, 0
    for b in batches:
        lo = 0
        while lo < b.num_rows:
            part = b.slice(lo, max(min(TILE_DOCS - docs, 256), 1))
            codes, first = _numbers(part.column(1), np.int64)
            weights, _ = _numbers(part.column(2), np.float64)
            held.append((np.repeat(part.column(0).to_numpy(), np.diff(first)), codes, weights))
            n, docs, lo = n + len(codes), docs + part.num_rows, lo + part.num_rows
            if n >= PACK or docs >= TILE_DOCS:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, n, docs = [], 0, 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _batch(query_id, doc_id, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query_id), pa.array(doc_id), pa.array(score)],
                                      ["query_id", "doc_id", "score"])
