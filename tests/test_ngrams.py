"""N-grams counted from word numbers against plain Python."""
from collections import Counter

import pyarrow as pa
import pytest

from quarry.operators import lexical, ngrams

TEXTS = ["The cat sat on the cat sat", "", None, "the", "a  b\ta b a", "cat sat", "on the"]
STOP = ["the", "on"]


def plain(text, low, high):
    words = [w for w in (text or "").lower().split() if w not in STOP]
    return Counter(" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1))


@pytest.mark.parametrize("ngram", [(1, 1), (1, 2), (2, 3)])
@pytest.mark.parametrize("most", [1, 5, 1 << 18])
def test_slices_give_the_plain_counts(ngram, most):
    lists = [None if t is None else t.lower().split() for t in TEXTS]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], ["d", "t"])
    got = [Counter() for _ in lists]
    for b in ngrams.token_slices([batch], 1, most):
        row, number, text = ngrams.slice_ngrams(b.column(1), ngram, STOP)
        for r, n in zip(row, number):
            got[b.column(0)[int(r)].as_py()][text[int(n)].as_py()] += 1
    assert got == [plain(t, *ngram) for t in TEXTS]


@pytest.mark.parametrize("told", [True, False])
def test_only_the_wanted_ngrams_leave_a_task(spark, monkeypatch, told):
    if not told:
        monkeypatch.setattr(lexical, "BROADCAST_MAX_BYTES", 0)
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "cat sat b")], "doc_id long, text string")
    wanted = ["cat sat", "b", "zzz", "a b"]
    only = spark.createDataFrame([(w,) for w in wanted], "term string")
    got = lexical.ngram_counts(docs, (1, 2), STOP, only=only)
    want = {(d, w): n for d, t in [*enumerate(TEXTS), (None, "cat sat b")]
            for w, n in plain(t, 1, 2).items() if w in wanted}
    assert {(r.doc_id, r.term): r.tf for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("Join" not in plan) == told
