"""Scores in tiles against brute force, and what is never built or stored."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluate, lexical, ranking, score_tiles


def _texts(seed, n, vocab, size):
    rnd = random.Random(seed)
    return [(i, " ".join(f"w{int(rnd.paretovariate(0.6)) % vocab}" for _ in range(rnd.randrange(size))))
            for i in range(n)]


@pytest.fixture(scope="module")
def task(spark):
    corpus = spark.createDataFrame(_texts(1, 120, 60, 30) + [(900, ""), (901, None)], "doc_id long, text string")
    queries = spark.createDataFrame(_texts(2, 40, 70, 9) + [(70, "nowhere")], "query_id long, query_text string")
    return lexical.bm25_index(corpus), corpus, queries


@pytest.mark.parametrize("least", [0.5, -1.0])
def test_tiles_equal_brute_force(monkeypatch, least):
    monkeypatch.setattr(score_tiles, "TILE_QUERIES", 7)
    monkeypatch.setattr(score_tiles, "TILE_DOCS", 11)
    monkeypatch.setattr(score_tiles, "SLAB", 3)
    monkeypatch.setattr(score_tiles, "PAIRS", 5)
    monkeypatch.setattr(score_tiles, "DENSE", 4)
    rnd = np.random.default_rng(3)
    d = np.sort(rnd.integers(0, 40, 300)) * 10          # rows of one document and term may repeat
    dc, dw = rnd.integers(0, 30, 300), rnd.uniform(0.1, 2, 300)
    q, qc, qw = rnd.integers(0, 20, 90), rnd.integers(0, 30, 90), rnd.uniform(least, 2, 90)
    want = np.zeros((20, 40))
    share = np.zeros((20, 40), dtype=bool)
    for i in range(90):
        at = np.flatnonzero(dc == qc[i])
        np.add.at(want, (q[i], d[at] // 10), qw[i] * dw[at])
        share[q[i], d[at] // 10] = True
    block, seen = score_tiles.QueryBlock(q, qc, qw), 0
    for rows, ids, score, hit in block.tiles(d, dc, dw):
        cells = np.ix_(block.ids[rows], ids // 10)
        assert score == pytest.approx(want[cells])
        assert (hit == share[cells]).all()
        seen += hit.size
    assert seen == len(np.unique(q)) * len(np.unique(d))


def test_many_queries_make_no_joined_rows(spark, task, monkeypatch):
    """Beyond the broadcast bound; the join's rows filled the disk at 0.1 GB."""
    index, _, queries = task

    def key(df):
        return sorted((r.query_id, r["rank"], r.doc_id, np.float32(r.score)) for r in df.collect())

    want = key(ranking.top_k_per_query(lexical.bm25_scores(index, queries, max_broadcast_bytes=1 << 20), 5))
    monkeypatch.setattr(lexical, "term_match_join", None)
    assert key(lexical.bm25_top(index, queries, 5, max_broadcast_bytes=10)) == want


def test_evaluation_stores_no_run(spark, task, monkeypatch):
    """Ranks are counted where the tiles are scored, query block by query block."""
    index, corpus, queries = task
    qrels = spark.createDataFrame([(q, d) for q in (*range(0, 40, 3), 70, 99) for d in (q, 2 * q, 900, 5000)],
                                  "query_id long, doc_id long")
    run = lexical.bm25_scores(index, queries)
    stored = spark.createDataFrame(run.collect(), run.schema)
    want = sorted(evaluate.qrel_ranks(stored, qrels, corpus, run_in_corpus=True).collect())
    pin, names = evaluate.materialize, []
    monkeypatch.setattr(evaluate, "materialize", lambda df, name="stage": names.append(name) or pin(df, name))
    assert sorted(evaluate.qrel_ranks(run, qrels, corpus, run_in_corpus=True).collect()) == want
    assert sorted(evaluate.qrel_ranks(run, qrels, corpus, run_in_corpus=True, max_bytes=500).collect()) == want
    assert set(names) == {"judged"}


def test_other_ids_are_scored_by_the_join(spark, task):
    index, _, queries = task
    named = queries.select(F.concat(F.lit("q"), "query_id").alias("query_id"), "query_text")
    got = {(r.query_id, r.doc_id): np.float32(r.score) for r in lexical.bm25_scores(index, named).collect()}
    want = {(f"q{r.query_id}", r.doc_id): np.float32(r.score) for r in lexical.bm25_scores(index, queries).collect()}
    assert got == want


def test_tokens_are_counted_in_slices():
    """A batch's arrays were counted whole, whatever the length of its texts."""
    rows = [["a"] * n for n in (3, 0, 4, 9, 1, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows, type=pa.list_(pa.string()))],
                                       ["k", "t"])
    parts = list(lexical._token_slices([batch], most=7))
    assert [p.num_rows for p in parts] == [3, 1, 3]
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()


def test_top_k_of_a_run_is_found_in_the_scoring_tasks(task, monkeypatch):
    index, _, queries = task
    run = lexical.bm25_scores(index, queries)
    want = sorted(map(tuple, ranking.top_k_per_query(run.select("*"), 3).collect()))    # sorts the run's rows
    calls = []
    plain = score_tiles.Scorer.top
    monkeypatch.setattr(score_tiles.Scorer, "top", lambda scorer, k: calls.append(k) or plain(scorer, k))
    got = ranking.top_k_per_query(run, 3)
    assert calls == [3] and sorted(map(tuple, got.collect())) == want


def _scorer(task, max_bytes):
    index, _, queries = task
    return score_tiles.Scorer(*lexical._bm25_sides(index, queries, "query_id", "query_text"), max_bytes)


def test_blocks_share_one_exchange(task):
    """Each block of queries joined, exchanged and sorted all postings before."""
    scorer = _scorer(task, 10)
    assert scorer.block_count() > 1
    got = []
    for k in range(3):
        df = scorer.map_tiles(k, 3, lambda ids, tiles: (score_tiles._batch(ids[q][np.nonzero(hit)[0]], docs[np.nonzero(hit)[1]], score[hit])
                                                        for q, docs, score, hit in tiles), score_tiles.SCHEMA)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and "Sort" not in plan
        got += [tuple(r) for r in df.collect()]
    want = {(r["query_id"], r["doc_id"]): r["score"] for r in _scorer(task, 1 << 20).run().collect()}
    assert len(got) == len(want) and all(want[q, d] == pytest.approx(s) for q, d, s in got)
    # the scores of pairs, sent to the documents' tasks
    pairs = scorer.query_terms.sparkSession.createDataFrame(
        [(q, d) for q in (0, 5, 39, 70) for d in (1, 2, 77, 900, 901, 5000)], "query_id long, doc_id long")
    for k in range(3):
        for r in scorer.pair_scores(scorer.block(pairs, k, 3), k, 3).collect():
            assert r["score"] == pytest.approx(want.get((r["query_id"], r["doc_id"]), 0.0))


@pytest.mark.parametrize("few", [0, 2, 8])
def test_tally_against_rows(monkeypatch, few):
    """Counts of a tile for queries with few and many relevant docs; scores of
    both signs, ties, unscored ones."""
    monkeypatch.setattr(evaluate, "FEW_PROBES", few)
    rnd = np.random.default_rng(few)
    queries, docs = np.array([3, 5, 9, 12]), np.arange(0, 60, 2)
    scores = rnd.integers(-2, 4, (4, 30)).astype(np.float32)
    q = np.repeat([3, 5, 12], [2, 9, 4])
    d = np.concatenate([rnd.choice(62, n, replace=False) for n in (2, 9, 4)])
    of = lambda x, y: float(scores[np.flatnonzero(queries == x)[0], y // 2]) if y < 60 and y % 2 == 0 else 0.0
    p = evaluate._Probes(None, q, d, np.array([of(x, y) for x, y in zip(q, d)]))
    n = len(p.doc) + len(p.first) - 1
    counts = {k: np.zeros(n, dtype=np.int64) for k in ("rank", "start", "end", "ids", "scored", "positive")}
    for lo in (0, 7, 20):                                   # in three tiles
        part = slice(lo, {0: 7, 7: 20, 20: 30}[lo])
        p.tally(counts, queries, docs[part], scores[:, part])
    for at, (g, doc, neg, zero) in enumerate(zip(p.gid, p.doc, p.neg, p.zero)):
        own = scores[np.flatnonzero(queries == p.queries[g])[0]]
        rows = [(-s, x) for s, x in zip(own.tolist(), docs.tolist()) if s]
        begin = (p.split[g] if zero else p.first[g]) + g
        got = {k: counts[k][begin:at + g + 1].sum() for k in ("rank", "start", "end", "ids")}
        if zero:
            assert got["ids"] == sum(x < doc for _, x in rows)
        else:
            assert got["rank"] == sum(r < (neg, doc) for r in rows)
            assert (got["start"], got["end"]) == (sum(s < neg for s, _ in rows), sum(s <= neg for s, _ in rows))
        assert counts["scored"][g] == len(rows) and counts["positive"][g] == sum(s < 0 for s, _ in rows)
