"""Registered queries: names, SQL, and the queries' results equal to it."""
import duckdb
import pytest
from conftest import SF001, SF01

import __spark_entry__ as E
from quarry.llm.registry import QUERIES

TABLES = "documents benchmark labels pages conversations".split()


def test_names():
    names = list(E.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(QUERIES) <= set(names)


@pytest.mark.parametrize("name", ["op2_quality_rules", "op5_line_dedup", "op10_url_filters",
                                  "op11_conversation_repair", "op12_ranked_search"])
@pytest.mark.parametrize("folder", [SF001, SF01])
def test_query_matches_sql(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    rel = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    df = E.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(cols)
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
