"""Top-k by impact bounds: block-max pruning inside the documents' tasks.

Scoring by a join makes a row per (query term, posting) and a group per (query,
document).  Here the query terms' postings cross one exchange once, to their
document's task, whatever the number of queries; a task cuts its documents
into blocks of ``BLOCK_DOCS`` and keeps, for each term and block, the largest
weight.  For each query

1. the bound of a block is the sum of its terms' largest weights there;
2. the blocks of the highest bounds are scored exactly, which gives a k-th
   best score (or a better one known from earlier documents of the task);
3. further blocks follow by falling bound, in batches that double, while their
   bound reaches the k-th best score so far; all others are never scored.
   Where an eighth is scored and more than a quarter of the blocks is left, all
   documents are scored from the query's postings, which then costs less.

A document scores at most its block's bound, so none of the best k is lost.
At most k rows per query (and equal scores) leave a chunk of documents.  The
queries are broadcast behind a check of their bytes; beyond it the join is used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BROADCAST_MAX_BYTES
from .ranking import top_k_per_query

BLOCK_DOCS = 8
CHUNK = 1 << 18            # postings searched at once
SLACK = 1e-6               # relative; well above the float32 precision of rankings
SCHEMA = "query_id long, doc_id long, score double"


class Chunk:
    """Postings of some documents, a document's rows adjacent; ``width``: number
    of terms."""

    def __init__(self, doc_id, code, weight, width: int, block: int = BLOCK_DOCS):
        head = np.ones(len(doc_id), dtype=bool)
        head[1:] = doc_id[1:] != doc_id[:-1]
        self.ids = doc_id[head]
        self.doc, self.code, self.weight = np.cumsum(head) - 1, code, weight
        n = len(self.ids)
        self.n_blocks = -(-n // block)
        first = np.append(np.flatnonzero(head), len(doc_id))
        self.block_first = first[np.minimum(np.arange(self.n_blocks + 1) * block, n)]
        order = np.argsort(code, kind="stable")          # by term, then document
        c = code[order]
        self.term_doc, self.term_weight = self.doc[order], weight[order]
        self.term_first = np.searchsorted(c, np.arange(width + 1))
        # the largest weight of each (term, block), by term
        own = self.term_doc // block
        new = np.ones(len(c), dtype=bool)
        new[1:] = (c[1:] != c[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(new)
        self.max_block = own[at]
        self.max_weight = np.maximum.reduceat(self.term_weight, at) if len(at) else np.zeros(0)
        self.max_first = np.searchsorted(c[at], np.arange(width + 1))

    def _sums(self, first, place, value, codes, weights, size: int, least: float = -np.inf):
        """(summed weight x value by place, whether a term is there) over the
        terms' ranges."""
        lo, hi = first[codes], first[codes + 1]
        at = _ranges(lo, hi)
        gain = np.maximum(np.repeat(weights, hi - lo) * value[at], least)
        own = place[at]
        return np.bincount(own, weights=gain, minlength=size), np.bincount(own, minlength=size) > 0

    def _score(self, blocks, dense):
        """(documents, scores) of the blocks' documents with a term of the query."""
        at = _ranges(self.block_first[blocks], self.block_first[blocks + 1])
        w = dense[self.code[at]]
        some = ~np.isnan(w)
        at, n = at[some], len(self.ids)
        total = np.bincount(self.doc[at], weights=w[some] * self.weight[at], minlength=n)
        docs = np.flatnonzero(np.bincount(self.doc[at], minlength=n))
        return docs, total[docs]

    def top(self, codes, weights, dense, k: int, floor: float):
        """(documents, scores, documents scored, k-th best score): every
        document that can be among the best k; ``floor``: a score that k
        documents are known to reach; ``dense``: the query's weight by term."""
        bound, touched = self._sums(self.max_first, self.max_block, self.max_weight, codes, weights,
                                    self.n_blocks, 0.0)
        order = np.flatnonzero(touched)
        order = order[np.argsort(-bound[order], kind="stable")]
        docs, score = np.zeros(0, dtype=np.int64), np.zeros(0)
        lo, size, kth = 0, -(-4 * k // BLOCK_DOCS), floor
        while lo < len(order) and bound[order[lo]] >= kth - abs(kth) * SLACK:
            left = order[lo:]
            left = left[bound[left] >= kth - abs(kth) * SLACK]
            if 4 * len(left) > self.n_blocks and (8 * lo >= len(order) or len(left) <= size):
                # most blocks are needed: all documents at once, by their terms
                total, hit = self._sums(self.term_first, self.term_doc, self.term_weight, codes, weights,
                                        len(self.ids))
                docs = np.flatnonzero(hit)
                score, lo = total[docs], len(order)
            else:
                more, s = self._score(np.sort(left[:size]), dense)
                docs, score = np.concatenate((docs, more)), np.concatenate((score, s))
            kth = max(kth, _kth(score, k))
            lo, size = lo + size, 2 * size
        good = score >= kth - abs(kth) * SLACK
        return docs[good], score[good], len(docs), kth


def _kth(score: np.ndarray, k: int) -> float:
    return float(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else -np.inf


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all lo..hi-1, one range after the other."""
    size = np.maximum(hi - lo, 0)
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(lo - (end - size), size)


def _chunks(batches, size: int):
    """(doc_id, code, weight) of whole documents, about ``size`` postings."""
    held, n = [], 0

    def merged():
        return tuple(np.concatenate(x) for x in zip(*held))

    for b in batches:
        if not b.num_rows:
            continue
        held.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        n += b.num_rows
        if n >= size:
            doc, code, weight = merged()
            cut = int(np.searchsorted(doc, doc[-1]))         # the last document may go on
            if cut:
                yield doc[:cut], code[:cut], weight[:cut]
            held, n = [(doc[cut:], code[cut:], weight[cut:])], len(doc) - cut
    if held:
        yield merged()


def impact_top_k(postings: DataFrame, query_terms: DataFrame, k: int,
                 max_bytes: int = BROADCAST_MAX_BYTES, chunk: int = CHUNK) -> DataFrame | None:
    """postings(doc_id, term, wd), query_terms(query_id, term, wq) -> the top-k
    run by summed wq * wd, with rank; None when the queries exceed
    ``max_bytes``.  Weights of postings are not negative."""
    from .lexical import bytes_at_most
    if not bytes_at_most(query_terms, max_bytes):
        return None
    spark = postings.sparkSession
    q = query_terms.select("query_id", "term", F.col("wq").cast("double").alias("wq")).toArrow()
    coded = q.column("term").combine_chunks().dictionary_encode()
    ids, owner = np.unique(q.column("query_id").to_numpy(), return_inverse=True)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((codes, owner))
    first = np.searchsorted(owner[order], np.arange(len(ids) + 1))
    shared = spark.sparkContext.broadcast((ids, codes[order], q.column("wq").to_numpy()[order], first,
                                           len(coded.dictionary)))
    terms = spark.createDataFrame(pa.table({"term": coded.dictionary.cast(pa.string()), "code": pa.array(
        np.arange(len(coded.dictionary)))})) if q.num_rows else spark.createDataFrame([], "term string, code long")

    def search(batches):
        ids, codes, weights, first, width = shared.value
        floor = np.full(len(ids), -np.inf)
        dense = np.full(width, np.nan)
        for part in _chunks(batches, chunk):
            c = Chunk(*part, width)
            out = []
            for i in range(len(ids)):
                own = slice(first[i], first[i + 1])
                dense[codes[own]] = weights[own]
                docs, score, _, floor[i] = c.top(codes[own], weights[own], dense, k, floor[i])
                dense[codes[own]] = np.nan
                out.append((np.full(len(docs), ids[i]), c.ids[docs], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)],
                                                 ["query_id", "doc_id", "score"])

    mine = postings.select("doc_id", "term", F.col("wd").cast("double").alias("wd")) \
        .join(F.broadcast(terms), "term").select("doc_id", "code", "wd")
    found = mine.repartition(F.col("doc_id")).sortWithinPartitions("doc_id").mapInArrow(search, SCHEMA)
    return top_k_per_query(found, k)
