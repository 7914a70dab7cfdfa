"""Top-k by impact bounds against the joined run; the saved index."""
import glob
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF01
from pyspark.sql import functions as F

from quarry.operators import impact, lexical, ranking, saved_index
from quarry.plans import tasks


def _rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, np.float32(r.score)) for r in df.collect())


def _texts(seed, n, vocab, size):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6)) % vocab}" for _ in range(n * size)]
    return [(i, " ".join(words[i * size:i * size + rnd.randrange(size)])) for i in range(n)]


@pytest.mark.parametrize("chunk", [60, 1 << 20])
def test_same_rows_as_the_join(spark, chunk):
    corpus = spark.createDataFrame(_texts(1, 300, 80, 30) + [(900, ""), (901, None)], "doc_id long, text string")
    queries = spark.createDataFrame(_texts(2, 25, 90, 9) + [(70, "nowhere"), (71, "")],
                                    "query_id long, query_text string")
    index = lexical.bm25_index(corpus)
    for k in (1, 7, 400):
        want = _rows(ranking.top_k_per_query(lexical.bm25_scores(index, queries), k))
        assert _rows(lexical.bm25_top(index, queries, k, chunk=chunk)) == want
        assert _rows(lexical.bm25_top(index, queries, k, max_broadcast_bytes=10)) == want
    tfidf = lexical.tfidf_index(corpus, (1, 2))
    assert _rows(lexical.tfidf_top(tfidf, queries, 5, chunk=chunk)) == \
        _rows(ranking.top_k_per_query(lexical.tfidf_scores(tfidf, queries), 5))


def test_equal_and_negative_scores(spark):
    post = spark.createDataFrame([(d, t, 1.0) for d in range(60) for t in ("a", "b") if t == "a" or d % 3],
                                 "doc_id long, term string, wd double")
    q = spark.createDataFrame([(1, "a", 1.0), (2, "a", -1.0), (2, "b", 0.5), (3, "b", -2.0)],
                              "query_id long, term string, wq double")
    want = post.join(q, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))
    for k in (4, 50):
        assert _rows(impact.impact_top_k(post, q, k)) == _rows(ranking.top_k_per_query(want, k))
    assert impact.impact_top_k(post, q.limit(0), 3).count() == 0
    assert impact.impact_top_k(post.limit(0), q, 3).count() == 0


def test_blocks_below_the_threshold_are_not_scored():
    """Few documents hold the rare term; the others' blocks can't reach them."""
    rnd = np.random.default_rng(2)
    n = 4000
    has = rnd.random((n, 3)) < np.array([0.01, 0.6, 0.8])
    doc, code = np.nonzero(has)
    c = impact.Chunk(doc, code, rnd.uniform(0.5, 2.0, len(doc)), 3)
    weights = np.array([9.0, 0.2, 0.1])
    docs, score, scored, kth = c.top(np.arange(3), weights, weights, 10, -np.inf)
    docs = c.ids[docs]
    want = np.bincount(doc, weights=weights[code] * c.weight, minlength=n)
    assert scored < 0.3 * n and kth == np.sort(want)[-10]
    assert set(np.flatnonzero(want >= kth)) <= set(docs.tolist()) and np.allclose(want[docs], score)
    # a floor from earlier documents prunes everything below it
    assert len(c.top(np.arange(3), weights, weights, 10, 1e9)[0]) == 0


def test_no_joined_rows_in_the_plan(spark, capsys):
    """One exchange of postings by document, one of the local best k."""
    corpus, queries = tasks.lexical_corpus(spark, SF01), tasks.lexical_queries(spark, SF01)
    lexical.bm25_top_k(corpus, queries, 10).explain("formatted")
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "HashAggregate" not in plan and "WindowGroupLimit" in plan
    assert "SortMergeJoin" not in plan


def test_saved_index_in_segments(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(saved_index, "ROW_GROUP_BYTES", 20_000)
    corpus, queries = tasks.lexical_corpus(spark, SF01), tasks.lexical_queries(spark, SF01)
    path = str(tmp_path / "index")
    for i in range(3):
        saved_index.add_segment(corpus.filter(F.pmod("doc_id", F.lit(3)) == i), path, f"s{i}")
    index = saved_index.open_index(spark, path)
    whole = lexical.bm25_index(corpus)
    stats = [{r.term: (r.df, round(r.idf, 9)) for r in x.term_stats.collect()} for x in (index, whole)]
    assert stats[0] == stats[1]
    assert _rows(saved_index.saved_top_k(index, queries, 10)) == _rows(lexical.bm25_top(whole, queries, 10))
    # one query's terms: ranges reach the scan, and few row groups hold them
    some = ["heonha", "thand"]
    part = index.postings.filter(saved_index.term_ranges(some))
    part.explain("formatted")
    assert "PushedFilters" in (plan := capsys.readouterr().out) and "GreaterThanOrEqual(term,heonha)" in plan
    groups = hit = 0
    for f in glob.glob(f"{path}/postings/*/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            column = next(c for c in map(meta.row_group(g).column, range(meta.num_columns))
                          if c.path_in_schema == "term")
            groups += 1
            hit += any(column.statistics.min <= t <= column.statistics.max for t in some)
    assert groups >= 12 and hit <= groups / 2
    with pytest.raises(Exception, match="(?i)exists"):
        saved_index.add_segment(corpus, path, "s0")


def test_term_ranges_hold_their_terms(spark):
    terms = ["b", "é", "a", "zz", "ab", "a", "Ω"]
    df = spark.createDataFrame([(t,) for t in sorted(set(terms)) + ["c", "zzz"]], "term string")
    for n in (1, 2, 64):
        got = {r.term for r in df.filter(saved_index.term_ranges(terms, n)).collect()}
        assert set(terms) <= got
    assert "zzz" not in {r.term for r in df.filter(saved_index.term_ranges(terms, 64)).collect()}
    assert df.filter(saved_index.term_ranges([])).count() == 0


def test_chunks_stay_small_whatever_a_task_holds():
    """Batches of 10,000 postings of 50 a document, 600,000 in all."""
    import numpy as np
    import pyarrow as pa

    from quarry.operators import impact
    doc = np.repeat(np.arange(12_000), 50)
    batches = [pa.RecordBatch.from_arrays([pa.array(doc[i:i + 10_000]), pa.array(doc[i:i + 10_000] % 7),
                                           pa.array(np.ones(10_000))], ["doc_id", "code", "wd"])
               for i in range(0, len(doc), 10_000)]
    sizes = [len(part[0]) for part in impact._chunks(iter(batches), impact.CHUNK)]
    assert sum(sizes) == len(doc) and max(sizes) <= (1 << 18) + 10_000
