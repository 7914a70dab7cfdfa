"""Approximate cosine search: an inverted-file index with sign sketches.

* Cells: spherical k-means on at most ``MAX_SAMPLE`` vectors drawn by hash; each
  vector of the corpus belongs to the cell of its nearest centre.  At most
  ``MAX_CELLS`` cells, so centres are small enough for every task.
* Sketches: ``bits`` signs of random orthogonal projections of the unit
  vector.  Their Hamming distance estimates the angle at an eighth of the
  bytes a float takes per sign, whatever the dimension.
* A query probes the nearest cells until they hold ``probe_share`` of the
  corpus (k + 1 vectors at least).  Of the vectors there, those within a
  Hamming distance that ``exact_share`` of all pairs keep -- measured on the
  sample -- are compared exactly, and of each block always as many of the
  nearest by sketch as its part of k + 1, so a query has k rows whenever the
  corpus has.

Queries are cut into blocks of bounded rows, and so are the cells: small ones
share a block, a hot one is several.  A task meets one pair of blocks, so a query's
vector is copied once a block, not once a cell, with a bit for each cell it
probes; at most k candidates of a query leave the task, however many are equal.
Vectors that are clustered need a small ``probe_share``; the fixture's are not
(ten nearest at a cosine of 0.3 in 64 dimensions), which the defaults suit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TILE_CELLS
from ..session import materialize
from .dense import RUN_SCHEMA, _unit_rows, _vectors
from .ranking import top_k_per_query

MAX_CELLS = 4096
ROWS_PER_CENTRE = 40           # sampled vectors per cell
MAX_SAMPLE = MAX_CELLS * ROWS_PER_CENTRE
SAMPLE_PAIRS = 512             # sampled vectors whose pairs set the sketch distance
BITS = 512
HAMMING_CELLS = 1 << 15        # sketch pairs compared at once
PROBE_SHARE = 0.85
EXACT_SHARE = 0.065


@dataclass
class VectorIndex:
    rows: DataFrame            # cell, doc_id, vec, sketch
    centres: np.ndarray        # cells x dimension
    sizes: np.ndarray          # vectors in each cell
    planes: np.ndarray         # dimension x bits
    sample: np.ndarray         # sketches that set the distance bound

    def distance_bound(self, share: float) -> int:
        """The Hamming distance that ``share`` of the sampled pairs keep."""
        s = self.sample
        if len(s) < 2:
            return self.planes.shape[1]
        d = hamming(s, s)[np.triu_indices(len(s), 1)]
        return int(np.quantile(d, share, method="lower"))


def sketches(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Packed signs, rows x (bits / 64)."""
    return np.packbits(unit @ planes > 0, axis=1).view(np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), dtype=np.int16 if 64 * a.shape[1] < 1 << 14 else np.int32)
    columns = np.ascontiguousarray(b.T)
    step = max(1, HAMMING_CELLS // max(len(b), 1))
    for i in range(0, len(a), step):             # what is made on the way stays in the cache
        for j in range(a.shape[1]):
            out[i:i + step] += np.bitwise_count(a[i:i + step, j][:, None] ^ columns[j][None])
    return out


def _planes(dim: int, bits: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))]
    return np.concatenate(parts, axis=1)[:, :bits]


def _centres(x: np.ndarray, cells: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; an emptied cell keeps its centre."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))]
    for _ in range(rounds):
        own = np.concatenate([(x[i:i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        filled = np.bincount(own, minlength=len(c)) > 0
        c = np.where(filled[:, None], _unit_rows(total), c)
    return c


def _sample(vectors: DataFrame, rows: int, total: int) -> np.ndarray:
    """At most ``rows`` unit vectors drawn by hash, the same in every run; about
    twice as many leave the tasks."""
    share = min(1.0, 2 * rows / max(total, 1))
    h = F.xxhash64("doc_id")
    got = vectors.select("vec", "doc_id", h.alias("h")) \
        .filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))) \
        .orderBy("h", "doc_id").limit(rows).toArrow()
    return _unit_rows(_vectors(got.column("vec")))


def build_index(corpus: DataFrame, cells: int | None = None, bits: int = BITS, seed: int = 7) -> VectorIndex:
    """corpus(doc_id, vec) -> index; ``cells`` defaults to half the square root
    of the number of vectors, up to ``MAX_CELLS``."""
    if bits % 64:
        raise ValueError("bits must be a multiple of 64")
    total = corpus.count()
    n = min(MAX_CELLS, cells or max(1, int(total ** 0.5) // 2))
    x = _sample(corpus, max(n * ROWS_PER_CENTRE, SAMPLE_PAIRS), total)
    dim = x.shape[1]
    centres = _centres(x, n, seed) if len(x) else np.zeros((1, dim))
    planes = _planes(dim, bits, seed) if dim else np.zeros((0, bits))
    shared = corpus.sparkSession.sparkContext.broadcast((centres, planes))

    def assign(batches):
        c, p = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            unit = _unit_rows(_vectors(b.column("vec")))
            code = sketches(unit, p).view(np.uint8).reshape(len(unit), -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((unit @ c.T).argmax(axis=1).astype(np.int32)), b.column("doc_id"), b.column("vec"),
                 pa.array([r.tobytes() for r in code], type=pa.binary())], ["cell", "doc_id", "vec", "sketch"])

    kind = dict(corpus.dtypes)["vec"]
    rows = corpus.select("doc_id", "vec").mapInArrow(
        assign, f"cell int, doc_id long, vec {kind}, sketch binary")
    # sorted by cell, a cell's files are those of its range; a hot cell spans several
    rows = materialize(rows.repartitionByRange("cell", F.xxhash64("doc_id"))
                       .sortWithinPartitions("cell"), "vector_index")
    sizes = np.zeros(len(centres), dtype=np.int64)
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():   # at most MAX_CELLS rows
        sizes[r["cell"]] = r["n"]
    return VectorIndex(rows, centres, sizes, planes, sketches(x[:SAMPLE_PAIRS], planes)
                       if len(x) else np.zeros((0, bits // 64), dtype=np.uint64))


def _probes(index: VectorIndex, queries: DataFrame, k: int, probe_share: float) -> DataFrame:
    """(query_id, qvec, probed, held): a bit for each cell that the query probes;
    these cells hold ``held`` vectors together."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, index.sizes))
    kind = dict(queries.dtypes)["vec"]

    def probe(batches):
        centres, sizes = shared.value
        need = max(probe_share * sizes.sum(), k + 1)
        step = max(1, TILE_CELLS // 4 // len(centres))
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                order = np.argsort(-(_unit_rows(_vectors(b.column("vec"))) @ centres.T), axis=1, kind="stable")
                used = np.cumsum(sizes[order], axis=1) - sizes[order] < need      # held before each cell
                bits = np.zeros(order.shape, dtype=bool)
                np.put_along_axis(bits, order, used, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("query_id"), b.column("vec"),
                     pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], type=pa.binary()),
                     pa.array((bits @ sizes).astype(np.int64))], ["query_id", "qvec", "probed", "held"])

    return queries.select("query_id", "vec").mapInArrow(probe, f"query_id long, qvec {kind}, probed binary, held long")


def _cell_blocks(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block of each cell, its blocks, all blocks): small cells share a
    block of about ``rows`` vectors, a larger one is several blocks."""
    first, count = np.zeros(len(sizes), dtype=np.int64), np.maximum(-(-sizes // rows), 1)
    block, held = 0, 0
    for c, n in enumerate(sizes.tolist()):
        if held and held + n > rows:
            block, held = block + 1, 0
        first[c] = block
        if count[c] > 1:
            block, held = block + int(count[c]), 0
        else:
            held += n
    return first, count, block + (held > 0)


def _best(query_id, doc_id, score, k: int):
    """Each query's best k in the order of rankings, ties included: no more rows
    are left, however many are equal."""
    order = np.lexsort((doc_id, -score.astype(np.float32).astype(np.float64), query_id))
    q = query_id[order]
    head = np.ones(len(q), dtype=bool)
    head[1:] = q[1:] != q[:-1]
    place = np.arange(len(q)) - np.flatnonzero(head)[np.cumsum(head) - 1]
    order = order[place < k]
    return query_id[order], doc_id[order], score[order]


def _compare(qids, qm, qs, held, dids, dm, ds, bound: int, k: int, exclude_self: bool, tile_cells: int):
    """(rows of the queries, their best k here, vectors compared exactly), tile by
    tile, of queries and the vectors of one cell."""
    bits = 64 * ds.shape[1]
    step = max(1, tile_cells // max(len(dids), 1))
    for i in range(0, len(qids), step):
        q = slice(i, i + step)
        far = hamming(qs[q], ds)
        if exclude_self:
            far[qids[q][:, None] == dids[None]] = bits + 1
        # this cell's part of k + 1 vectors, so that all cells have k at least
        part = min(len(dids), -(-len(dids) * (k + 1) // int(held[q].min())))
        limit = np.maximum(np.partition(far, part - 1, axis=1)[:, part - 1], bound)
        near = (far <= limit[:, None]) & (far <= bits)
        x, y = np.nonzero(near)
        score = np.empty(len(x))
        lo = 0
        while lo < len(x):             # gathered rows of bounded size
            hi = lo + max(1, tile_cells // max(qm.shape[1], 1))
            score[lo:hi] = np.einsum("ij,ij->i", qm[q][x[lo:hi]], dm[y[lo:hi]])
            lo = hi
        some = np.isfinite(score)
        yield q, _best(qids[q][x[some]], dids[y[some]], score[some], k), near.sum(axis=1)


def _search_block(left: pa.Table, right: pa.Table, planes, bound: int, k: int, exclude_self: bool,
                  tile_cells: int) -> pa.RecordBatch:
    """Candidates of a block of queries in a block of cells, and per query what
    was compared; at most k + 1 rows a query."""
    qids, dids = (t.column(c).to_numpy().astype(np.int64) for t, c in ((left, "query_id"), (right, "doc_id")))
    qm, dm = _unit_rows(_vectors(left.column("qvec"))), _unit_rows(_vectors(right.column("vec")))
    qs = sketches(qm, planes)
    ds = np.frombuffer(b"".join(right.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(dids), -1)
    probed = np.frombuffer(b"".join(left.column("probed").to_pylist()), dtype=np.uint8).reshape(len(qids), -1)
    held, cell = left.column("held").to_numpy(), right.column("cell").to_numpy()
    compared, sketched = np.zeros(len(qids), dtype=np.int64), np.zeros(len(qids), dtype=np.int64)
    best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    waiting, n = [best], 0
    order = np.argsort(cell, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        c = int(cell[own[0]])
        rows = np.flatnonzero(probed[:, c // 8] >> (7 - c % 8) & 1)
        for q, top, near in _compare(qids[rows], qm[rows], qs[rows], held[rows], dids[own], dm[own], ds[own],
                                     bound, k, exclude_self, tile_cells):
            compared[rows[q]] += near
            sketched[rows[q]] += len(own)
            waiting.append(top)
            n += len(top[0])
            if n > tile_cells // 8:
                waiting = [_best(*(np.concatenate(x) for x in zip(*waiting)), k)]
                n = 0
    best = _best(*(np.concatenate(x) for x in zip(*waiting)), k)
    some = np.flatnonzero(sketched)
    none = np.zeros(len(best[0]), dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((best[0], qids[some]))),
         pa.concat_arrays([pa.array(best[1]), pa.nulls(len(some), pa.int64())]),
         pa.concat_arrays([pa.array(best[2]), pa.nulls(len(some), pa.float64())]),
         pa.array(np.concatenate((none, compared[some]))), pa.array(np.concatenate((none, sketched[some])))],
        ["query_id", "doc_id", "score", "compared", "sketched"])


def _candidates(index: VectorIndex, queries: DataFrame, k: int, probe_share: float, exact_share: float,
                exclude_self: bool, query_rows: int, corpus_rows: int, tile_cells: int) -> DataFrame:
    """query_id, doc_id, score, compared, sketched: candidates (doc_id set) and
    counts (doc_id null)."""
    spark = queries.sparkSession
    probes = materialize(_probes(index, queries, k, probe_share), "probes")
    first, count, n_blocks = _cell_blocks(index.sizes, corpus_rows)
    cells = spark.createDataFrame(                                  # at most MAX_CELLS rows
        [(c, int(first[c]), int(count[c])) for c in range(len(first))], "cell int, first long, nd long")
    nq = max(1, -(-probes.count() // query_rows))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = probes.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq).cast("long"))) \
        .withColumn("db", each(max(n_blocks, 1)))
    right = index.rows.join(F.broadcast(cells), "cell").withColumn(
        "db", F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("nd"))).drop("first", "nd").withColumn("qb", each(nq))
    bound, planes = index.distance_bound(exact_share / probe_share), index.planes
    schema = RUN_SCHEMA + ", compared long, sketched long"
    kinds = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64()),
                       ("compared", pa.int64()), ("sketched", pa.int64())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            out = [_search_block(a, b, planes, bound, k, exclude_self, tile_cells)]
        return pa.Table.from_batches(out, schema=kinds)

    key = ["qb", "db"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, schema)


def search_index(index: VectorIndex, queries: DataFrame, k: int = 10, probe_share: float = PROBE_SHARE,
                 exact_share: float = EXACT_SHARE, exclude_self: bool = False, query_rows: int = 4096,
                 corpus_rows: int = 65_536, tile_cells: int = TILE_CELLS) -> DataFrame:
    """queries(query_id, vec) -> approximate top-k run with rank."""
    got = _candidates(index, queries, k, probe_share, exact_share, exclude_self, query_rows, corpus_rows, tile_cells)
    return top_k_per_query(got.filter("doc_id is not null").select("query_id", "doc_id", "score"), k)


def search_with_counts(index: VectorIndex, queries: DataFrame, k: int = 10, probe_share: float = PROBE_SHARE,
                       exact_share: float = EXACT_SHARE, exclude_self: bool = False, query_rows: int = 4096,
                       corpus_rows: int = 65_536, tile_cells: int = TILE_CELLS) -> tuple[DataFrame, DataFrame]:
    """(run with rank, per query the vectors compared by sketch and exactly)."""
    got = materialize(_candidates(index, queries, k, probe_share, exact_share, exclude_self, query_rows,
                                  corpus_rows, tile_cells), "vector_candidates")
    run = top_k_per_query(got.filter("doc_id is not null").select("query_id", "doc_id", "score"), k)
    return run, got.groupBy("query_id").agg(F.sum("compared").alias("compared"), F.sum("sketched").alias("sketched"))


def search_quality(run: DataFrame, exact: DataFrame, counts: DataFrame, n_docs) -> DataFrame:
    """One row: n_queries, n_rows, recall of the exact run, share of all pairs
    compared exactly and by sketch."""
    hit = exact.select("query_id", "doc_id").join(run.select("query_id", "doc_id", F.lit(1).alias("hit")),
                                                  ["query_id", "doc_id"], "left")
    recall = hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    rows = run.agg(F.count(F.lit(1)).alias("n_rows"))
    work = counts.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("compared").alias("c"), F.sum("sketched").alias("s"))
    pairs = F.col("n_queries") * n_docs
    return work.select("n_queries", rows.scalar().alias("n_rows"), recall.scalar().alias("recall"),
                       (F.col("c") / pairs).alias("compared_share"), (F.col("s") / pairs).alias("sketched_share"))
