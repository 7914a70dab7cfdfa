"""Operators with an exact brute-force version."""
import random

import brute
import pytest
from brute import awkward, documents
from conftest import SF001
from pyspark.sql import functions as F

from quarry.llm import linededup, qualityrules, sharding, suffixdedup


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def small_documents(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"])
            for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]


@pytest.mark.parametrize("which", ["awkward", "table", "empty"])
def test_line_dedup(spark, which):
    data = {"awkward": awkward, "table": lambda: small_documents(spark), "empty": list}[which]()
    # columns whose names the operator uses itself
    docs = documents(spark, data).withColumns({"d": F.lit(1), "h1": F.lit("x"), "drop": F.lit(2)})
    got = linededup.dedup_lines(docs)
    assert rows(got) == sorted(brute.lines(data), key=repr)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_substrings_awkward(spark, keep):
    data = [r for r in awkward() if r[0] != 9] if keep == "first" else awkward()
    data = [r for r in data if len(r[1] or "") < 20000]
    got = suffixdedup.dedup_substrings(documents(spark, data), 400, keep)
    assert rows(got) == sorted(brute.substrings(data, 400, keep), key=repr)


@pytest.mark.parametrize("bucket", [2, 256])
def test_substrings_edges(spark, bucket):
    """Shared stretches of every length around the limit, at random places."""
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefgh \n") for _ in range(n))
    core = noise(900)
    data = []
    for i in range(60):
        n = rnd.choice([380, 398, 399, 400, 401, 420, 700])
        a = rnd.randrange(0, len(core) - n)
        data.append((i, noise(rnd.randrange(0, 300)) + core[a:a + n] + noise(rnd.randrange(0, 300))))
    got = suffixdedup.dedup_substrings(documents(spark, data), 400, "none", max_bucket=bucket)
    assert rows(got) == sorted(brute.substrings(data, 400), key=repr)
    got = suffixdedup.dedup_substrings(documents(spark, data), 400, "first", max_bucket=bucket)
    assert rows(got) == sorted(brute.substrings(data, 400, "first"), key=repr)


def test_substrings_tiles(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "TILE", 1000)
    data = [r for r in awkward() if len(r[1] or "") < 20000] + [(30, "b" + "cd" * 2500)]
    got = suffixdedup.dedup_substrings(documents(spark, data), 400, "none")
    assert rows(got) == sorted(brute.substrings(data, 400), key=repr)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("bucket", [2, 256])
def test_substrings_across_tile_borders(spark, monkeypatch, keep, bucket):
    """Passages of 400 to 700 bytes over every border of a long text, and
    their copies elsewhere."""
    monkeypatch.setattr(suffixdedup, "TILE", 2000)
    rnd = random.Random(8)
    noise = lambda n: "".join(rnd.choice("abcdefgh \n") for _ in range(n))
    long_ = noise(41000)
    data = [(1, long_)]
    for i in range(1, 20):
        n = rnd.randrange(400, 700)
        a = 2000 * i - rnd.randrange(1, n)
        data.append((100 + i, noise(rnd.randrange(0, 300)) + long_[a:a + n] + noise(rnd.randrange(0, 300))))
    got = suffixdedup.dedup_substrings(documents(spark, data), 400, keep, max_bucket=bucket)
    assert rows(got) == sorted(brute.substrings(data, 400, keep), key=repr)


def test_substrings_table(spark):
    data = small_documents(spark)
    got = suffixdedup.dedup_substrings(documents(spark, data), 400, "none", keep_text=True)
    assert rows(got.drop("text")) == sorted(brute.substrings(data, 400), key=repr)


@pytest.mark.parametrize("which", ["awkward", "table", "empty"])
def test_quality_base(spark, which):
    data = {"awkward": awkward, "table": lambda: small_documents(spark), "empty": list}[which]()
    got = qualityrules.judge(documents(spark, data)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(got) == sorted(((r[0], *brute.quality_base(r[1])) for r in data), key=repr)


def test_sharding(spark):
    for data in (awkward(), small_documents(spark), []):
        got = sharding.shard_by_bytes(documents(spark, data), payload=("lang",)).toPandas()
        assert len(got) == len(data)
        if not data:
            continue
        assert sorted(got["size"]) == sorted(len((r[1] or "").encode()) + 1 for r in data)
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        assert got.shard.between(0, 15).all()
    plain = sharding.shard_by_bytes(documents(spark, small_documents(spark))).toPandas()
    by = plain.groupby("shard")["size"].sum()
    assert by.max() - by.min() < 0.05 * by.mean()
    assert (plain.groupby("text_crc32").shard.nunique() == 1).all()


def test_sharding_hot_text(spark):
    data = [(i, "hot " * 30) for i in range(400)] + [(1000 + i, f"text {i} " * (i % 9 + 1)) for i in range(600)]
    got = sharding.shard_by_bytes(documents(spark, data)).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 16 and by.max() < 1.1 * by.mean()
    again = sharding.shard_by_bytes(documents(spark, data[::-1])).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))


def test_splitters_are_bounded_and_overfull_ranges_subdivided(spark, monkeypatch):
    # a third of the bytes lie in one narrow stretch of keys, a tenth in one key
    data = [(f"b{i:06d}", 10) for i in range(4000)] + [(f"m{i:06d}", 600) for i in range(50)] \
        + [("t", 900)] * 10 + [(f"x{i:06d}", 10) for i in range(4000)]
    keys = spark.createDataFrame(data, "__key string, __size long")
    total = sum(n for _, n in data)
    monkeypatch.setattr(sharding, "SAMPLE_PER_RANGE", 4)     # a poor first sample
    splitters = sharding.choose_splitters(keys, 20, total)
    held = {}
    for k, n in data:
        at = sum(s <= k for s in splitters)
        held.setdefault(at, [0, set()])
        held[at][0] += n
        held[at][1].add(k)
    assert 10 < len(splitters) < 100 and splitters == sorted(set(splitters))
    assert all(b <= sharding.OVERFULL * total / 20 or "t" in names for b, names in held.values())
    assert sharding.choose_splitters(keys.limit(0), 20, 0) == []
    # longer ranges give the same contract
    monkeypatch.setattr(sharding, "MAX_RANGES", 4)
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", 1)
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 10)
    got = sharding.shard_by_bytes(documents(spark, small_documents(spark)), shards=4).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert by.max() - by.min() < 0.05 * by.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_substrings_hot_keys_empty_tables_long_texts_and_clashing_columns(spark, monkeypatch):
    """Keys dealt over tasks from 5 rows on; a very long text with copies over
    its tile borders; no rows; columns named like the operator's own."""
    import random

    from quarry.llm import suffixdedup
    monkeypatch.setattr(suffixdedup, "SALT_ROWS", 5)
    monkeypatch.setattr(suffixdedup, "TILE", 20_000)
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    passage, other = word(900), word(450)
    long_ = word(19_700) + passage + word(19_000) + other + word(30_000)
    rows = [(1, long_)] + [(i, word(50) + passage + word(70)) for i in range(2, 42)]
    rows += [(50, other + word(9)), (51, word(399)), (52, None), (53, "")] + [(60, other)] * 12
    full = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows],
                                 "doc_id long, text string, d int, h int, n string, salt int")
    for keep in ("none", "first"):
        got = suffixdedup.dedup_substrings(full.repartition(4), 400, keep)
        want = brute.substrings(rows if keep == "none" else [r for i, r in enumerate(rows) if r not in rows[:i]],
                                400, keep)
        assert sorted(set(map(tuple, got.collect())), key=repr) == sorted(set(want), key=repr)
    assert suffixdedup.dedup_substrings(full.limit(0), 400, "none").count() == 0
    texts = {r["doc_id"]: r["text"] for r in suffixdedup.dedup_substrings(full, 400, "none", keep_text=True).collect()}
    assert passage not in texts[1] and other not in texts[1] and texts[60] == "" and texts[51] == rows[-15][1]
