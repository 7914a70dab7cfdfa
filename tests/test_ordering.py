import random

from quarry.operators.ordering import count_preceding, dense_index


def test_dense_index_with_hot_group(spark):
    rnd = random.Random(5)
    # one group holds most of the rows
    rows = [(0 if rnd.random() < 0.7 else rnd.randint(1, 9), rnd.randint(0, 50), i) for i in range(800)]
    df = spark.createDataFrame(rows, "g long, k long, id long")
    out = {(r.g, r.id): r.idx for r in dense_index(df, ["k", "id"], "idx", group=["g"]).collect()}
    for g in {r[0] for r in rows}:
        ordered = sorted((k, i) for gg, k, i in rows if gg == g)
        for pos, (k, i) in enumerate(ordered):
            assert out[(g, i)] == pos


def test_count_preceding_strict(spark):
    rnd = random.Random(9)
    pts = [(rnd.randint(0, 3), rnd.randint(0, 20)) for _ in range(500)]
    prb = [(rnd.randint(0, 3), rnd.randint(0, 20), j) for j in range(60)]
    p = spark.createDataFrame(pts, "g long, k long")
    q = spark.createDataFrame(prb, "g long, k long, pid long")
    got = {r.pid: r.n_before for r in count_preceding(p, q, ["g"], ["k"]).collect()}
    for g, k, j in prb:
        assert got[j] == sum(1 for gg, kk in pts if gg == g and kk < k)
    # no group at all
    got0 = {r.pid: r.n_before for r in count_preceding(p.select("k"), q.select("k", "pid"), [], ["k"]).collect()}
    for g, k, j in prb:
        assert got0[j] == sum(1 for gg, kk in pts if kk < k)
