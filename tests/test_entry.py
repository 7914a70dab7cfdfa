"""The driver contract: entry() runs on sf0.001, and a quick sample of
registered queries equals its oracle SQL in DuckDB."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001, SF01
from quarry.plans.catalog import QUERIES

TABLES = "documents embeddings benchmark labels conversations".split()
# also compared on the second, larger set
LARGER = ["bm25_top_k", "tfidf_top_k_2gr", "evaluate_run", "combined_benchmark", "split_counts",
          "cosine_top_k_block", "write_summary_csv", "prepare_retrieval_task", "nested_train_subsets"]
CORE = sorted(set(E.oracle_sql()) & set(QUERIES))
KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT",
        "date": "DATE", "boolean": "BOOLEAN"}


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "doc_id", "rank", "score"]
    assert df.count() > 0


def test_every_query_has_sql_or_is_documented():
    assert set(QUERIES) - set(E.oracle_sql()) == {"cosine_top_k_lsh"}


def compare(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    sdf = E.queries()[name](spark, folder)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    ints = {"BIGINT", "HUGEINT", "INTEGER"}
    for c, t in sdf.dtypes:
        assert KIND[t] == kinds[c] or {KIND[t], kinds[c]} <= ints, (c, t, kinds[c])
    order = sorted(dcols)
    s = sorted((tuple(_norm(r[c]) for c in order) for r in sdf.collect()), key=repr)
    d = sorted((tuple(_norm(r[dcols.index(c)]) for c in order) for r in drows), key=repr)
    assert s == d


@pytest.mark.parametrize("name", CORE)
def test_query_matches_oracle(spark, name):
    compare(spark, name, SF001)


@pytest.mark.parametrize("name", LARGER)
def test_query_matches_oracle_on_more_data(spark, name):
    compare(spark, name, SF01)
