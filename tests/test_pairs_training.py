import random

from quarry.operators import pairs, training


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(cur[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def _lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(cur[-1], prev[j]))
        prev = cur
    return prev[-1]


def test_pair_kernels_match_plain_dp(spark):
    rnd = random.Random(4)
    words = ["a", "b", "c", "d", "e"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))),
             " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    rows.append((999, "", "x y z"))
    df = spark.createDataFrame(rows, "query_id long, query_text string, doc_text string") \
        .withColumn("doc_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0))
    got = {r.query_id: r for r in pairs.pair_features(df, 2).collect()}
    for i, a, b in rows:
        ta, tb = a.split(), b.split()
        g = got[i]
        assert g.edit_distance == _lev(ta, tb) and g.lcs == _lcs(ta, tb)
        ga = {tuple(ta[k:k + 2]) for k in range(len(ta) - 1)}
        gb = {tuple(tb[k:k + 2]) for k in range(len(tb) - 1)}
        assert g.common_ngrams == len(ga & gb)


def test_training_batches_are_full_and_seeded(spark):
    df = spark.createDataFrame([(i, 0) for i in range(70)], "conv_id long, turn long")
    a = {(r.conv_id, r.turn): (r.batch_id, r.slot)
         for r in training.training_batches(df, ["conv_id", "turn"], seed=1).collect()}
    b = {(r.conv_id, r.turn): (r.batch_id, r.slot)
         for r in training.training_batches(df, ["conv_id", "turn"], seed=1).collect()}
    c = {(r.conv_id, r.turn): (r.batch_id, r.slot)
         for r in training.training_batches(df, ["conv_id", "turn"], seed=2).collect()}
    assert a == b and a != c
    assert sorted(set(a.values())) == [(i // 16, i % 16) for i in range(70)]


def test_subsets_take_any_id(spark):
    ids = [2 ** 62 + 100 * i for i in range(2000)]
    df = spark.createDataFrame([(i, 1) for i in ids], "query_id long, n_relevant long")
    got = {r.fraction: r.n_queries for r in training.nested_train_subsets(df).collect()}
    assert got[100] == 2000
    # equal steps between ids don't bias the draw
    assert all(abs(got[f] - 20 * f) < 120 for f in range(10, 100, 10))


def test_edit_distance_of_long_and_odd_sequences():
    import random

    from quarry.operators.pairs import edit_distance_tokens

    def plain(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
            prev = row
        return prev[-1]

    rnd = random.Random(8)
    for _ in range(300):
        a, b = (rnd.choices("abcdé", k=rnd.randrange(0, 90)) for _ in range(2))
        assert edit_distance_tokens(a, b) == plain(a, b) == edit_distance_tokens(b, a)
    long_ = rnd.choices("abcdefgh", k=700)
    other = [x for x in long_ if rnd.random() < 0.8]
    assert edit_distance_tokens(long_, other) == plain(long_, other)
    assert edit_distance_tokens(None, ["a"]) is None and edit_distance_tokens([], []) == 0
