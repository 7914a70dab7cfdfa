import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.plans.tasks import contains_pairs
from quarry.sources import files


def test_paragraph_csv_round_trip(spark):
    rows = [(1, 'comma, "quoted"\nnew line', dt.date(2016, 1, 2)),
            (2, "NA", dt.date(2019, 5, 6)), (3, "  padded  ", None),
            (4, "", dt.date(2020, 1, 1)), (5, None, dt.date(2021, 2, 3))]
    df = spark.createDataFrame(rows, files.PARAGRAPH_SCHEMA)
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-csv-"), "pars")
    files.write_csv(df, path)
    back = {r.par_id: (r.text, r.date) for r in files.read_paragraphs(spark, path).collect()}
    # an empty field reads as null, as a pandas reader would; text_as_string
    # later maps both to ''
    assert back == {r[0]: (r[1] or None, r[2]) for r in rows}


def test_jsonl_round_trip_keeps_nulls(spark):
    rows = [(1, "q one", [3, 3, 7]), (2, None, []), (3, "x", None)]
    df = spark.createDataFrame(rows, files.QUERY_JSONL_SCHEMA)
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-jsonl-"), "q")
    files.write_jsonl(df, path)
    back = sorted(tuple(r) for r in files.read_jsonl(spark, path, files.QUERY_JSONL_SCHEMA).collect())
    assert back == sorted(rows)
    text = "".join(open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".json"))
    assert '"query_text":null' in text


def test_summary_format_matches_printf(spark):
    vals = [0.03125, 0.5, 1 / 3, 0.00015, 0.99995, 0.0, 1.0, 0.123456789]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(files.format_fixed(F.col("x"))).collect()]
    assert got == ["%.4f" % v for v in vals]


def test_contains_pairs_equals_substring_scan(spark):
    docs = ["the quick brown fox jumps", "a quick brown fox", "xquick brown foxes run",
            "nothing here", "brown fox jumps over quick brown fox"]
    passages = ["quick brown fox", "brown fox jumps", "k brown fo", "fox", "n fox", "xq", " "]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    p = spark.createDataFrame(list(enumerate(passages)), "query_id long, query_text string")
    got = sorted(tuple(r) for r in contains_pairs(d, p).collect())
    exp = sorted((qi, di) for qi, q in enumerate(passages) for di, t in enumerate(docs) if q in t and q.strip())
    assert got == exp
    assert sorted(tuple(r) for r in contains_pairs(d, p, max_bytes=30).collect()) == exp


def test_missing_inputs_raise(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_citations(spark, "/nonexistent/edges").collect()
    with pytest.raises(ValueError, match="missing splits: validation"):
        files.read_split_edges(spark, {"train": "a", "test": "b"})


def test_repeated_paragraph_ids_raise(spark):
    from quarry.operators.split import prepare_retrieval_task
    par = spark.createDataFrame([(1, "a", dt.date(2015, 1, 1)), (1, "b", dt.date(2016, 1, 1))],
                                "par_id long, text string, date date")
    edges = spark.createDataFrame([(1, 1)], "par_id_from long, par_id_to long")
    with pytest.raises(ValueError, match="par_id is not unique"):
        prepare_retrieval_task(par, edges)


def test_texts_stay_in_their_tasks(spark):
    """Candidate pairs are sent to the texts; the texts crossed an exchange before."""
    d = spark.createDataFrame([(i, f"filler one two{i % 7} three four{i}") for i in range(50)], "doc_id long, text string")
    p = spark.createDataFrame([(1, "one two3 three"), (2, "one two3 four3")], "query_id long, query_text string")
    got = contains_pairs(d, p)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(tuple(r) for r in got.collect()) == [(1, i) for i in range(3, 50, 7)]
