import collections
import math
import random

import pytest

from quarry.operators import lexical
from quarry.operators.ranking import top_k_per_query


def _bm25_python(docs, query, k1=1.2, b=0.75, eps=0.25):
    toks = [d.lower().split() for d in docs]
    n = len(toks)
    avgdl = sum(map(len, toks)) / n
    tfs = [collections.Counter(t) for t in toks]
    df = collections.Counter()
    for c in tfs:
        df.update(c.keys())
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    avg = sum(idf.values()) / len(idf)
    idf = {w: (eps * avg if v < 0 else v) for w, v in idf.items()}
    out = []
    for i, c in enumerate(tfs):
        s = 0.0
        for w in query.lower().split():
            f = c.get(w, 0)
            s += idf.get(w, 0) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(toks[i]) / avgdl))
        out.append(s)
    return out


def _corpus(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bm25_golden(spark):
    docs = ["a b c", "a a d", "a e", "b b b f", "a", ""]
    queries = ["a b", "a a", "zzz", "b f f"]
    c = _corpus(spark, docs)
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query_text string")
    run = {(r.query_id, r.doc_id): r.score
           for r in lexical.bm25_scores(lexical.bm25_index(c), q).collect()}
    for qi, qt in enumerate(queries):
        exp = _bm25_python(docs, qt)
        for di, e in enumerate(exp):
            assert abs(run.get((qi, di), 0.0) - e) < 1e-9
    # repeated query token doubles the contribution
    assert run[(1, 4)] == pytest.approx(2 * _bm25_python(docs, "a")[4])


def test_bm25_salted_join_equals_broadcast(spark):
    rnd = random.Random(1)
    words = ["w%d" % i for i in range(30)] + ["the"] * 20
    docs = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))) for _ in range(120)]
    queries = [" ".join(rnd.choice(words) for _ in range(6)) for _ in range(15)]
    c = _corpus(spark, docs)
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query_text string")
    idx = lexical.bm25_index(c)
    a = {(r.query_id, r.doc_id): r.score for r in lexical.bm25_scores(idx, q).collect()}
    b = {(r.query_id, r.doc_id): r.score for r in
         lexical.bm25_scores(idx, q, max_broadcast_bytes=0, rows_per_salt=40).collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def _tfidf_python(docs, queries, stop, ngram_hi, vocab_size):
    def grams(t):
        tk = [w for w in t.lower().split() if w not in stop]
        out = list(tk)
        if ngram_hi == 2:
            out += [tk[i] + " " + tk[i + 1] for i in range(len(tk) - 1)]
        return collections.Counter(out)
    dc = [grams(d) for d in docs]
    cf, df = collections.Counter(), collections.Counter()
    for c in dc:
        cf.update(c)
        df.update(c.keys())
    vocab = sorted(cf, key=lambda w: (-cf[w], w))[:vocab_size]
    n = len(docs)
    idf = {w: math.log((1 + n) / (1 + df[w])) + 1 for w in vocab}

    def vec(c):
        v = {w: c[w] * idf[w] for w in c if w in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}
    dv = [vec(c) for c in dc]
    out = {}
    for qi, qt in enumerate(queries):
        qv = vec(grams(qt))
        for di, d in enumerate(dv):
            s = sum(qv[w] * d.get(w, 0.0) for w in qv)
            if s:
                out[(qi, di)] = s
    return out


@pytest.mark.parametrize("hi", [1, 2])
def test_tfidf_matches_formula(spark, hi):
    rnd = random.Random(hi)
    words = ["w%d" % i for i in range(25)] + ["the", "and", "of"]
    docs = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))) for _ in range(80)]
    queries = [" ".join(rnd.choice(words) for _ in range(5)) for _ in range(10)] + ["the and"]
    stop = ["the", "and", "of"]
    c = _corpus(spark, docs)
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query_text string")
    idx = lexical.tfidf_index(c, ngram=(1, hi), vocab_size=40, stop_words=stop)
    got = {(r.query_id, r.doc_id): r.score for r in lexical.tfidf_scores(idx, q).collect()}
    exp = _tfidf_python(docs, queries, set(stop), hi, 40)
    assert got.keys() == exp.keys()   # stop-word-only query: no rows (zero vector)
    assert all(abs(got[k] - exp[k]) < 1e-12 for k in exp)


def test_top_k_more_than_corpus(spark):
    c = _corpus(spark, ["a b", "a", "b c"])
    q = spark.createDataFrame([(0, "a b c")], "query_id long, query_text string")
    top = top_k_per_query(lexical.bm25_scores(lexical.bm25_index(c), q), 20).collect()
    assert len(top) == 3 and sorted(r["rank"] for r in top) == [1, 2, 3]


def test_parameters_reach_the_index(spark):
    docs = ["a b c d", "a a a b", "c c d", "a"]
    c = _corpus(spark, docs)
    q = spark.createDataFrame([(0, "a c")], "query_id long, query_text string")
    plain = {r.doc_id: r.score for r in lexical.bm25_top_k(c, q, 10).collect()}
    other = {r.doc_id: r.score for r in lexical.bm25_top_k(c, q, 10, k1=2.0, b=0.1).collect()}
    want = {r.doc_id: r.score for r in top_k_per_query(
        lexical.bm25_scores(lexical.bm25_index(c, k1=2.0, b=0.1), q), 10).collect()}
    assert other == want and other != plain
    small = lexical.tfidf_top_k(c, q, 10, vocab_size=1, stop_words=[]).collect()
    assert {r.doc_id for r in small} == {i for i, t in enumerate(docs) if "a" in t.split()}


def test_postings_need_no_exchange(spark):
    from quarry.functions.text import tokenize
    from pyspark.sql import functions as F
    c = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a b a").alias("text"))
    rows = lexical.count_terms(c, F.col("doc_id"), tokenize("text"))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.term, r.tf) for r in rows.filter("doc_id = 3").collect()) == [("a", 2), ("b", 1)]


def test_wide_query_side_joins_hot_terms_by_salt(spark):
    """Beyond the broadcast bound no exchange is keyed by the bare term."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        post = spark.range(500).selectExpr("id as doc_id", "if(id % 5 = 0, 'rare', 'the') as term")
        terms = spark.createDataFrame([("the", i) for i in range(9)] + [("rare", 1)], "term string, query_id long")
        j = lexical.term_match_join(post, terms, max_broadcast_bytes=0, rows_per_salt=300)
        plan = j._jdf.queryExecution().executedPlan().toString()
        keyed = [x for x in plan.splitlines() if "Exchange hashpartitioning(term" in x]
        assert keyed and all("_salt" in x for x in keyed)
        assert j.count() == 400 * 9 + 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
