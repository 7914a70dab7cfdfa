import datetime as dt

from quarry.operators import split


def _par(spark, rows):
    return spark.createDataFrame(rows, "par_id long, text string, date date")


def _edges(spark, rows):
    return spark.createDataFrame(rows, "par_id_from long, par_id_to long")


def test_split_boundaries(spark):
    years = [2016, 2017, 2018, 2019, 2021, 2022, None]
    p = _par(spark, [(i, "t", dt.date(y, 6, 1) if y else None) for i, y in enumerate(years)])
    got = {r.par_id: r.split for r in split.temporal_split(p).collect()}
    assert [got[i] for i in range(len(years))] == ["train", "val", "val", "test", "test", None, None]


def test_whole_query_drop_outside_target_and_duplicates(spark):
    p = _par(spark, [
        (1, "train par", dt.date(2015, 1, 1)), (2, "val par", dt.date(2017, 1, 1)),
        (10, "test a", dt.date(2019, 1, 1)), (11, "test b", dt.date(2020, 1, 1)),
        (12, "test c", dt.date(2021, 1, 1)), (20, "late", dt.date(2022, 1, 1)),
        (3, "train src", dt.date(2014, 1, 1))])
    e = _edges(spark, [
        (10, 1), (10, 11),          # cites a test paragraph -> whole query dropped
        (12, 20),                   # only an outside target -> no judgement
        (11, 1), (11, 1), (11, 2),  # duplicate edge
        (3, 1), (3, 1), (3, 99)])   # training source, duplicate + unknown target
    task = split.prepare_retrieval_task(p, e)
    assert sorted(r.par_id_from for r in
                  split.drop_within_test_queries(e, p).collect()) == [11, 12]
    assert sorted((r.query_id, r.doc_id) for r in task["qrels"].collect()) == [(11, 1), (11, 2)]
    assert [r.query_id for r in task["queries"].collect()] == [11]
    assert sorted(r.doc_id for r in task["corpus"].collect()) == [1, 2, 3]
    tq = task["train_queries"].collect()
    assert [(r.query_id, r.relevant_docs, r.n_relevant) for r in tq] == [(3, [1, 1, 99], 3)]
    lists = {r.par_id_from: r.targets for r in split.citations_by_source(e).collect()}
    assert lists[11] == [1, 1, 2]
