"""The pipeline, stage by stage: each works on all that the one before kept."""
import brute
import pytest
from brute import WORD, awkward, documents
from conftest import SF001, SF01
from test_methods import brute_classes, brute_leaks

import corpus_pipeline as P
from quarry.llm import mixing


def stages(spark, docs, folder, tmp):
    out = [docs]
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, out[-1], folder).write.parquet(f"{tmp}/{k}")
        out.append(spark.read.parquet(f"{tmp}/{k}"))
    return out


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality rules", "near-dedup", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("folder", [SF001])
def test_pipeline_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    steps = stages(spark, docs, folder, tmp_path)
    rows = [[(r["doc_id"], r["text"], r["lang"], r["source"]) for r in s.select(
        "doc_id", "text", "lang", "source").collect()] for s in steps]
    start, good, single, clean, mixed, _ = rows
    for s in steps[:5]:
        assert set(s.columns) == set(docs.columns)
    # quality: base rules hold, and labelled good documents that pass them stay
    assert all(not brute.quality_base(t)[5] for _, t, *_ in good)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {d for d, *_ in good}
    missed = [d for d, t, *_ in start if label.get(d) == 1 and not brute.quality_base(t)[5] and d not in kept]
    assert len(missed) <= 0.01 * len(kept)
    # near-dedup: the smallest doc_id of every class
    pairs = [(d, t) for d, t, *_ in good]
    want = sorted(min(pairs[i][0] for i in m) for m in brute_classes(pairs).values())
    assert sorted(d for d, *_ in single) == want
    # decontamination: every verbatim leak goes, few others
    leaks = {d for d, _ in brute_leaks([(d, t) for d, t, *_ in single], bench)}
    left = {d for d, *_ in clean}
    assert not leaks & left and len(left) >= len(single) - len(leaks) - 1
    # mixing: each source's words come to its target
    words = lambda rs: sum(len(WORD.findall(t or "")) for _, t, *_ in rs)
    names = sorted({s for *_, s in clean})
    sizes = [words([r for r in clean if r[3] == n]) for n in names]
    target = mixing.water_fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes))
    for n, t in zip(names, target):
        assert abs(words([r for r in mixed if r[3] == n]) - t) <= 1
    # sharding: every mixed row once, slots without gaps
    last = steps[-1].toPandas()
    assert sorted(last.text) == sorted(t for _, t, *_ in mixed)
    for _, g in last.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert P.run(spark, folder).count() == len(last)


@pytest.mark.parametrize("data", [awkward(), []])
def test_pipeline_odd_inputs(spark, data, tmp_path):
    docs = documents(spark, data)
    steps = stages(spark, docs, SF001, tmp_path)
    n = [s.count() for s in steps]
    assert n[1] <= n[0] and n[2] <= n[1] and n[3] <= n[2] and n[5] == n[4]
