"""The heaviest terms by summaries against plain counts."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import heavy_terms, lexical


def lists(spark, rows, parts):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "doc_id long, tk array<string>") \
        .repartition(parts)


def zipf(seed, docs=120, words=400, length=60):
    rnd = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    return [rnd.choices([f"w{i}" for i in range(words)], weights, k=length) for _ in range(docs)]


@pytest.mark.parametrize("counters", [4, 16, 64, 1 << 18])
@pytest.mark.parametrize("parts", [1, 5])
def test_bounds_hold(spark, monkeypatch, counters, parts):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = zipf(counters) + [None, [], ["w0", None, "w0"]]
        cf = Counter(t for r in data for t in r or () if t is not None)
        got = {r["term"]: r["low"] for r in heavy_terms.term_summary(
            lists(spark, data, parts), F.col("tk"), counters).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    lost = got.pop(None)
    assert lost <= 2 * sum(cf.values()) / counters
    assert all(got.get(t, 0) <= n <= got.get(t, 0) + lost for t, n in cf.items())
    assert set(got) <= set(cf)


@pytest.mark.parametrize("size", [1, 10, 50, 1000])
def test_candidates_hold_the_top_and_its_ties(spark, size):
    for data in (zipf(size), [[f"w{i % 300}"] for i in range(900)], [["a", "b"]] * 30 + [["c"]] * 30):
        cf = Counter(t for r in data for t in r)
        last = sorted(cf.values(), reverse=True)[:size][-1]
        got = {r["term"] for r in heavy_terms.top_candidates(
            lists(spark, data, 4), F.col("tk"), size, counters=8).collect()}
        assert {t for t, n in cf.items() if n >= last} <= got
    # a summary that is large enough sends a small part of the terms
    few = heavy_terms.top_candidates(lists(spark, zipf(1, 400), 2), F.col("tk"), 5, counters=128).count()
    assert 5 <= few < 60


def test_empty_and_null(spark):
    none = lists(spark, [[]], 1)
    assert heavy_terms.top_candidates(none.limit(0), F.col("tk"), 5).count() == 0
    assert heavy_terms.top_candidates(none, F.col("tk"), 5).count() == 0
    assert [r["term"] for r in heavy_terms.top_candidates(
        lists(spark, [None, ["a", None]], 2), F.col("tk"), 5).collect()] == ["a"]


def test_vocabulary_is_the_same_at_every_summary_size(spark):
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(zipf(9))], "doc_id long, text string")
    want = None
    for counters in (8, 64, 1 << 18):
        idx = lexical.tfidf_index(docs, (1, 2), 80, stop_words=[], counters=counters)
        got = sorted(map(tuple, idx.vocab.select("term", "cf", "df").collect()))
        assert want is None or got == want
        want = got
    other = lexical.tfidf_index(docs, (1, 2), 80, stop_words=[], vocab_corpus=docs)
    assert sorted(map(tuple, other.vocab.select("term", "cf", "df").collect())) == want
    assert other.weights.count() == idx.weights.count()
