"""Operators against brute force on small inputs, and their parts against
plain versions."""
import itertools
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from brute import WORD, awkward, documents
from conftest import SF001, SF01
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import (crf, decontaminate, mixing, orderminhash, qualityrules, textscan, tokencount,
                        urlfilter)
from quarry.llm.components import components
from quarry.llm.textscan import Texts


def frame(spark, name, sf=SF001):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------ text scanning

@given(st.lists(st.one_of(st.none(), st.text("ab \n\té,", max_size=30)), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_and_lines(texts):
    t = Texts(pa.array(texts, type=pa.string()))
    ws, we, first = t.words()
    ls, le, lfirst = t.lines()
    for i, x in enumerate(texts):
        raw = (x or "").encode()
        assert [t.raw[a:b] for a, b in zip(ws[first[i]:first[i + 1]], we[first[i]:first[i + 1]])] == raw.split()
        assert [t.raw[a:b] for a, b in zip(ls[lfirst[i]:lfirst[i + 1]], le[lfirst[i]:lfirst[i + 1]])] \
            == raw.split(b"\n")


def test_sliced_arrays_and_hashes():
    col = pa.array(["x y", None, "longer word-with-more-than-sixteen-bytes x", "y"]).slice(1)
    t = Texts(col)
    ws, we, first = t.words()
    assert first.tolist() == [0, 0, 3, 4]
    h = textscan.range_hash(t.raw, ws, we)
    u = Texts(pa.array(["word-with-more-than-sixteen-bytes", "x", "y", "word-with-more-than-sixteen-bytez"]))
    g = textscan.range_hash(u.raw, *u.words()[:2])
    assert h[1] == g[0] and h[2] == g[1] and h[3] == g[2] and g[3] != g[0]
    s, sfirst = textscan.shingles(h, first, 5)
    assert sfirst.tolist() == [0, 0, 1, 2]


# --------------------------------------------------------------- components

def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + \
        [(1000, i) for i in range(1001, 1300)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, None)]
    got = {r["node"]: r["root"] for r in components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent}


# ------------------------------------------------------------ quality rules

def test_thresholds_follow_their_group(spark):
    rnd = random.Random(1)
    words = lambda n: " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(n))
    rows = [(i, words(80), "en", "plain") for i in range(300)]
    # in this source every document has 20% symbols; that is usual there
    rows += [(1000 + i, words(80) + " #####" * 20, "en", "code") for i in range(300)]
    rows += [(2000, words(80) + " ####" * 80, "en", "plain"), (2001, words(80), None, None)]
    got = {r["doc_id"]: r for r in qualityrules.judge(documents(spark, rows)).collect()}
    assert all(got[i]["kept"] for i in range(300)) and all(got[1000 + i]["kept"] for i in range(300))
    assert not got[2000]["kept"] and got[2001]["kept"]


def test_a_source_of_one_third_junk_does_not_raise_its_own_limit(spark):
    """Sources a to d hold clean text, the largest one a third of junk as
    well; one source uses more symbols than the others and keeps its own."""
    rnd = random.Random(5)

    def text(symbols, n=100):
        return " ".join(f"{rnd.randrange(10 ** 6):06d}x" for _ in range(n)) + " " + "#" * symbols

    rows = [(k * 1000 + i, text(rnd.choice((0, 0, 0, 2, 4))), "en", s)
            for k, s in enumerate("abcd") for i in range(150)]
    rows += [(10000 + i, text(rnd.choice((0, 2, 4))), "en", "hot") for i in range(600)]
    junk = [(20000 + i, text(60 + rnd.randrange(200)), "en", "hot") for i in range(300)]
    usual = [(30000 + i, text(20 + rnd.choice((0, 2, 4))), "en", "code") for i in range(150)]
    odd = [(40000, text(24), "en", "a"), (40001, text(24), "en", "code")]   # one text, two verdicts
    got = {r["doc_id"]: r for r in qualityrules.judge(documents(spark, rows + junk + usual + odd)).collect()}
    assert all(got[r[0]]["kept"] for r in rows + usual)
    assert not any(got[r[0]]["kept"] for r in junk)
    assert not got[40000]["kept"] and got[40001]["kept"]


def test_limits_differ_between_groups(spark):
    """On given data: limits come from the sketches, and the same value of a
    metric is accepted in one group and rejected in another."""
    docs = frame(spark, "documents", SF01)
    got = qualityrules.judge(docs, min_docs=10, keep=("source",)).toPandas()
    for m in ("dup_lines", "repeats", "shouting"):
        assert got[f"max_{m}"].nunique() > 3, m
    for m in ("dup_lines", "repeats"):
        out = got[~got.base_failed & (got[m] > got[f"max_{m}"])]
        assert any(((got[f"max_{m}"] >= v) & ~got.base_failed).any() for v in out[m]), m


def test_quality_rules_odd_inputs(spark):
    """Clashing names, nulls in any column, one very long text, repeated rows,
    an empty table."""
    rows = [(None, None, None, None), (1, "", "en", None), (1, "", "en", None),
            (2, "word " * 400000, "en", "s"), (3, " ".join(map(str, range(90))), None, "s")]
    docs = documents(spark, rows).withColumns({"kept": F.lit(1), "value": F.lit("x"), "metric": F.lit(2)})
    got = qualityrules.judge(docs).collect()
    assert len(got) == 5 and [r["n_words"] for r in got if r["doc_id"] == 2] == [400000]
    assert [r["kept"] for r in got if r["doc_id"] == 3] == [True]
    assert all(r["base_failed"] for r in got if r["doc_id"] != 3)
    empty = qualityrules.judge(docs.limit(0))
    assert empty.count() == 0 and empty.columns == qualityrules.judge(docs).columns


def test_quality_rules_keep_good_documents(spark):
    got = qualityrules.judge(frame(spark, "documents", SF01)).join(frame(spark, "labels", SF01), "doc_id")
    pdf = got.select("kept", "quality", "base_failed").toPandas()
    good, bad = pdf[(pdf.quality == 1) & ~pdf.base_failed], pdf[pdf.quality == 0]
    assert good.kept.mean() > 0.99
    assert bad.kept.mean() < 0.1


# --------------------------------------------------------------- classifier

@pytest.mark.parametrize("segment", [1, 3, 512])
def test_forward_backward_against_enumeration(monkeypatch, segment):
    monkeypatch.setattr(crf, "SEGMENT", segment)
    rnd = np.random.default_rng(0)
    first = np.array([0, 1, 4, 8])
    e, trans = rnd.normal(size=(8, 2)), rnd.normal(size=(2, 2))
    a, b, z = crf.forward_backward(e, first, trans)
    for lo, hi in zip(first[:-1], first[1:]):
        paths = list(itertools.product((0, 1), repeat=hi - lo))
        w = np.array([np.exp(sum(e[lo + t, y] for t, y in enumerate(p))
                             + sum(trans[p[t], p[t + 1]] for t in range(len(p) - 1))) for p in paths])
        for t in range(hi - lo):
            p1 = sum(x for x, p in zip(w, paths) if p[t]) / w.sum()
            assert abs(np.exp(a[lo + t, 1] + b[lo + t, 1] - z[lo + t]) - p1) < 1e-9


def own_line_features(line, earlier):
    """Plain version of the features of a line itself."""
    words = line.split()
    solid = sum(map(len, words))
    n, out = max(len(words), 1), []
    for table in crf.CLASSES:
        share = sum(table[b] for b in line) / max(solid, 1)
        out += [share, share ** 0.5, share > 0.08]
    again = sum(x == y for x, y in zip(words, words[1:]))
    one = sum(len(x) == 1 for x in words)
    return out + [again / n, again > 2, one / n, one / n > 0.3, bool(words) and line in earlier,
                  np.log1p(len(words)) / 5, min(solid / n, 30) / 10, solid / n < 3, solid / n > 9,
                  not words, 0 < len(words) < 4]


@pytest.mark.parametrize("piece", [1, 40, 1 << 18])
def test_line_features_and_potentials(monkeypatch, piece):
    monkeypatch.setattr(crf, "PIECE", piece)
    texts = [None, "", "\n\n", "One two two two two\n\n# $5\nOne two two two two\nab", "ab", "é" * 30 + "\nx y z!"]
    want = []
    for text in texts:
        lines = (text or "").encode().split(b"\n")
        own = [own_line_features(x, lines[:i]) for i, x in enumerate(lines)]
        none = [0.0] * crf.N_OWN
        for i, x in enumerate(own):
            want.append([*x, *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none),
                         i == 0, i + 1 == len(own), 1])
    t = Texts(pa.array(texts))
    x, size, first = crf.line_features(t)
    assert np.allclose(x, np.array(want, dtype=float))
    weights = np.random.default_rng(2).normal(size=(x.shape[1], 2))
    e, size2, first2 = crf.potentials(t, weights)
    assert np.allclose(e, x @ weights) and (size == size2).all() and (first == first2).all()
    # a document's raw quality: its lines' marginals, weighted by their bytes
    model = crf.Model(weights, np.zeros((2, 2)), 2.0, -1.0)
    p = 1 / (1 + np.exp(e[:, 0] - e[:, 1]))
    w = np.maximum(size, 1)
    raw = np.array([(p * w)[i:j].sum() / w[i:j].sum() for i, j in zip(first[:-1], first[1:])])
    assert np.allclose(model.score(t), 1 / (1 + np.exp(1 - 2 * raw)))


def test_training_sample_is_bounded_and_long_texts_are_scored_whole(spark):
    rows = [(i, f"text {i}\n" * 10) for i in range(1, 60)] + [(60, "\n" * 300_000), (61, "a b c\n" * 90_000)]
    docs, labels = documents(spark, rows), spark.createDataFrame(
        [(i, i % 2, 0) for i, _ in rows], frame(spark, "labels").schema)
    texts, marks = crf.training_sample(docs, labels, max_bytes=2000, max_lines=400)
    assert 0 < len(texts) == len(marks) < 40 and sum(len(x) for x in texts.to_pylist()) <= 2000
    texts, _ = crf.training_sample(docs, labels)
    assert max(len(x) for x in texts.to_pylist()) < 1000 and len(texts) > 40
    got = crf.score_documents(docs, labels)
    assert got.count() == len(rows) and got.filter("score between 0 and 1").count() == len(rows)


def test_classifier_on_held_out_rows(spark):
    docs, labels = frame(spark, "documents", SF01), frame(spark, "labels", SF01)
    pdf = crf.score_documents(docs, labels).join(labels, "doc_id").toPandas()
    pdf = pdf[pdf.held_out]
    assert len(pdf) > 30 and (pdf.predicted == pdf.quality).mean() > 0.93
    assert pdf.score.between(0, 1).all() and ((pdf.score >= 0.3) == (pdf.predicted == 1)).all()


def test_classifier_odd_inputs(spark):
    docs = documents(spark, awkward()).withColumn("quality", F.lit("clash"))
    labels = frame(spark, "labels", SF01)
    got = crf.score_documents(docs, labels.filter("doc_id < 0"))
    assert got.count() == len(awkward()) and got.filter("score = 0.5").count() == len(awkward())
    got = crf.score_documents(docs, spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (6, 0, 0), (7, None, 0), (None, 1, 1), (8, 0, 0), (10, 1, 0)],
        labels.schema))
    assert got.filter("score between 0 and 1").count() == len(awkward())
    assert crf.score_documents(documents(spark, []), labels).count() == 0


# ------------------------------------------------------------------- mixing

def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = mixing.permute(np.arange(n), n, 5)
        assert sorted(p) == list(range(n))
        assert n < 17 or (p != mixing.permute(np.arange(n), n, 6)).any()


def check_mix(rows, got, pdf):
    size = {}
    for d, t, _, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.water_fill(
        [size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(size.values()))))
    assert sorted(pdf["size"]) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
    assert (pdf.taken <= 2 * pdf["size"]).all() and (pdf.taken >= 0).all()
    for s in names:
        own = pdf[pdf.source.isna() if s is None else pdf.source == s]
        assert (own.target - target[s]).abs().max() < 1e-6 and (own.source_size == size[s]).all()
        assert abs(own.taken.sum() - target[s]) <= 1


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_mixing(spark, block):
    for rows in ([(r[0], r[1], *(r[2:] or ("en", "s1"))) for r in awkward()],
                 [tuple(r) for r in frame(spark, "documents").select(
                     "doc_id", "text", "lang", "source").collect()]):
        docs = documents(spark, rows)
        got = mixing.mix_sources(docs, block_words=block, slots_per_shard=16)
        pdf = got.toPandas()
        check_mix(rows, got, pdf)
        again = mixing.mix_sources(docs.repartition(3), block_words=block, slots_per_shard=16).toPandas()
        key = lambda p: sorted(map(repr, p.itertuples(index=False)))
        assert key(pdf) == key(again)
        text = mixing.mixed_documents(docs, block_words=block, slots_per_shard=16).toPandas()
        words = text.text.map(lambda x: len(WORD.findall(x)))
        assert words.sum() == pdf.taken.sum() and (words > 0).all()


def test_mixing_empty(spark):
    assert mixing.mix_sources(documents(spark, [])).count() == 0
    assert mixing.mixed_documents(documents(spark, [(1, None), (2, " ")])).count() == 0


# ---------------------------------------------------------- decontamination

def brute_leaks(docs, items):
    out = set()
    for d, t in docs:
        s = " " + " ".join(WORD.findall((t or "").lower())) + " "
        out |= {(d, i) for i, x in items if " " + " ".join(WORD.findall(x.lower())) + " " in s}
    return out


def test_decontamination_recall(spark):
    docs, bench = frame(spark, "documents", SF01), frame(spark, "benchmark", SF01)
    want = brute_leaks([tuple(r) for r in docs.select("doc_id", "text").collect()],
                       [tuple(r) for r in bench.collect()])
    got = decontaminate.contaminated(docs, bench).toPandas()
    pairs = set(zip(got.doc_id, got.item_id))
    assert len(want) >= 10 and len(pairs & want) >= 0.97 * len(want)
    assert all(r.lcs_words >= 0.65 * r.item_words for r in got.itertuples())
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.count() == docs.count() - len(set(got.doc_id))


def test_decontamination_paraphrase_and_odd_inputs(spark):
    rnd = random.Random(9)
    vocab = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ana", "emo", "ilu", "ora", "upi", "ast")]
    text = lambda n: [rnd.choice(vocab) + rnd.choice(vocab) for _ in range(n)]
    item = text(40)
    para = list(item)
    for i in range(1, 35, 4):
        para[i] = "changed"           # the last five words, the answer, stay
    wrong = list(para)
    wrong[-5:] = text(5)
    rows = [(i, " ".join(text(200))) for i in range(40)]
    rows += [(100, " ".join(text(50) + item + text(50))), (101, " ".join(text(33) + para + text(9))),
             (102, " ".join(text(60) + wrong + text(5))), (103, None), (104, ""),
             (105, " ".join(item)), (105, " ".join(text(20))), (106, " ".join(item[:10]))]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, None), (3, "two words")],
                                  "item_id long, text string")
    got = decontaminate.contaminated(documents(spark, rows), bench).toPandas()
    assert sorted(got.doc_id) == [100, 100, 101, 101, 105, 105]
    assert decontaminate.contaminated(documents(spark, []), bench).count() == 0
    none = decontaminate.contaminated(documents(spark, rows), bench.filter("item_id > 9"))
    assert none.count() == 0


def matches(items, table, texts):
    h, first = decontaminate._hashes(Texts(pa.array(texts, type=pa.string()), lower=True))
    return decontaminate.match(items, table, h, first, decontaminate.COSINE)


def test_decontamination_finds_paraphrases(spark):
    """Items with a third of their words replaced, evenly, and the answer kept,
    planted in real texts: they align with 0.65 to 0.8 of the item."""
    docs, bench = frame(spark, "documents", SF01), frame(spark, "benchmark", SF01)
    table = decontaminate.latent_table(docs)
    texts = [WORD.findall(r["text"].lower()) for r in docs.select("text").orderBy("doc_id").collect()]
    given_ = [WORD.findall(r["text"].lower()) for r in bench.select("text").orderBy("item_id").collect()]
    items = decontaminate.Items(list(range(len(given_))), [" ".join(w) for w in given_],
                                [None] * len(given_), table)
    rnd = random.Random(7)
    vocab = [w for t in texts[:200] for w in t]
    hosts = [t for t in texts if len(t) > 60]
    short = [i for i, w in enumerate(given_) if len(w) < 30]
    rows, want = [], []
    while len(rows) < 400:
        i = rnd.choice(short)
        words, para, n = given_[i], list(given_[i]), len(given_[i])
        k, o = int(0.35 * n), rnd.random()
        for x in range(k):
            para[int((x + o) * (n - 5) / k)] = rnd.choice(vocab)
        if 0.65 * n <= plain_lcs(words, para) < 0.8 * n:
            host = rnd.choice(hosts)
            cut = rnd.randrange(len(host))
            rows.append(" ".join(host[max(cut - 80, 0):cut] + para + host[cut:cut + 80]))
            want.append(i)
    found = matches(items, table, rows)
    assert sum((k, i) in found for k, i in enumerate(want)) >= 0.92 * len(want)
    for (k, i), (got, _, _) in list(found.items())[:20]:
        assert 0.65 * len(given_[i]) <= got <= plain_lcs(given_[i], rows[k].split())


def test_decontamination_finds_short_items(spark):
    """Verbatim copies of items of 5 to 15 words, anywhere in real texts."""
    docs = frame(spark, "documents")
    table = decontaminate.latent_table(docs)
    texts = [WORD.findall(r["text"].lower()) for r in docs.select("text").orderBy("doc_id").collect()]
    hosts = [t for t in texts if len(t) > 60]
    rnd = random.Random(6)
    given_ = []
    for n in range(5, 16):
        for _ in range(20):
            t = rnd.choice(hosts)
            a = rnd.randrange(len(t) - n)
            given_.append(t[a:a + n])
    items = decontaminate.Items(list(range(len(given_))), [" ".join(w) for w in given_],
                                [None] * len(given_), table)
    rows = []
    for w in given_:
        host = rnd.choice(hosts)
        cut = rnd.randrange(len(host))
        rows.append(" ".join(host[max(cut - 80, 0):cut] + w + host[cut:cut + 80]))
    found = matches(items, table, rows)
    assert all(found[i, i][0] == len(w) for i, w in enumerate(given_) if (i, i) in found)
    assert sum((i, i) in found for i in range(len(given_))) == len(given_)


# --------------------------------------------------------------- near dedup

def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@given(st.lists(st.integers(0, 6), max_size=40), st.lists(st.integers(0, 6), max_size=40),
       st.integers(0, 40))
@settings(max_examples=400, deadline=None)
def test_banded_alignment(a, b, need):
    m = plain_lcs(a, b)
    got = orderminhash.aligned(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), need)
    assert got <= m and (got >= need) == (m >= need) and (m < need or got == m)


def brute_classes(rows):
    """Components of all pairs whose aligned 5-word shingles reach 0.8."""
    seqs = []
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        seqs.append([tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))] if w else [])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = seqs[i], seqs[j]
        if a and b and len(set(a) & set(b)) and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
            m = plain_lcs(a, b)
            if m >= 0.8 * (len(a) + len(b) - m):
                parent[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return out


def variants():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rnd.randrange(6, 160))]
        for _ in range(rnd.randrange(1, 7)):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                i = rnd.randrange(len(w))
                w[i:i + 1] = rnd.choice([[word()], [], [w[i], word()]])
            rows.append((n, " ".join(w) if w else None))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "two words"), (n + 3, "Two  WORDS"), (n + 4, "two words x")]


def test_near_duplicates(spark):
    rows = variants()
    rows += [(900 + i, ("same text over and over again " * 12).strip()) for i in range(8)]
    rnd = random.Random(2)
    rnd.shuffle(rows)
    got = orderminhash.near_duplicates(documents(spark, rows), block=3).collect()
    cls = {r["doc_id"]: r["class_id"] for r in got}
    want = {}
    for members in brute_classes(rows).values():
        for i in members:
            want[rows[i][0]] = min(rows[j][0] for j in members)
    assert len(got) == len(rows) and cls == want


def test_near_duplicates_odd_inputs(spark):
    docs = documents(spark, awkward() + [(6, awkward()[6][1])]).withColumns(
        {"d": F.lit(0), "node": F.lit("x"), "root": F.lit("y")})
    got = orderminhash.near_duplicates(docs).collect()
    assert len(got) == len(awkward()) + 1
    kept = orderminhash.distinct_documents(docs)
    assert kept.columns == docs.columns and kept.schema["root"].dataType == docs.schema["root"].dataType
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    assert (False, 7) not in ids and ids.count((False, 6)) == 1
    assert orderminhash.near_duplicates(documents(spark, [])).count() == 0
    assert orderminhash.distinct_documents(documents(spark, [])).count() == 0


# ------------------------------------------------------------- token counts

def public_tokenizer(pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers
    tok = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokencount.MARK, prepend_scheme="always",
                                                 split=False)
    return tok


def test_token_counts_equal_the_tokenizer(spark):
    pieces = tokencount.load_vocabulary()
    tok = public_tokenizer(pieces)
    rows = [(r["doc_id"], r["text"]) for r in frame(spark, "documents").collect()]
    rows += [(10 ** 6 + i, x) for i, x in enumerate(
        ["  two  spaces ", "\n\n", "emoji \U0001F600\U0001F601 x", "<s> </s> <0x0A>", "a" * 3000, "日本語 テキスト"])]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(documents(spark, rows)).collect()}
    assert got == {d: len(tok.encode(t, add_special_tokens=False).ids) for d, t in rows}
    empty = tokencount.count_tokens(documents(spark, [(1, None), (2, "")])).collect()
    assert [r["n_tokens"] for r in empty] == [0, 0]


@given(st.text("ab c\n", min_size=1, max_size=30), st.integers(0, 30))
@settings(max_examples=150, deadline=None)
def test_tie_rules(text, seed):
    rnd = random.Random(seed)
    names = {tokencount.MARK, "a", "b"} | {"".join(rnd.choice("ab" + tokencount.MARK) for _ in range(rnd.randrange(2, 5)))
                                           for _ in range(8)}
    pieces = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", -9.0) for b in range(256)] + \
        [(p, -float(rnd.randrange(1, 4))) for p in sorted(names)]
    tok = public_tokenizer(pieces)
    n, score = tokencount.Counter(pieces).count(text)
    enc = tok.encode(text, add_special_tokens=False)
    assert n == len(enc.ids)


# -------------------------------------------------------------- url filters

def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urlfilter.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(rule) > len(best[0]):
                best = rule, verdict
    return host, path, best


def test_url_rules(spark):
    urls = [r["url"] for r in frame(spark, "pages").collect()] + [
        None, "", "no scheme.com/en/", "http://COM/", "http://com", "http://example.com/en/x",
        "http://WWW.Example.com/en/x", "http://a.b.net/fr/?q=://x", "http://notexample.com/en/",
        "x://net/es/", "http://h.net/es", "http://h.org?x=/fr/#a", "a://b://c.net/fr/", "http:///fr/"]
    pages = spark.createDataFrame([(i, u, "<p>x</p>" if i % 2 else None) for i, u in enumerate(urls)],
                                  "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(pages).collect()}
    for i, u in enumerate(urls):
        host, path, best = brute_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[0])
        if best:
            assert got[i]["verdict"] == best[1]


def test_url_aliases(spark):
    link = '<html><LINK href="{}" rel="canonical"></html>'
    rows = [
        (1, "http://a.org/1", link.format("http://x.net/fr/9")),       # linked to a blocked page
        (2, "https://www.a.org/1/#top", None),                         # redirects to 1
        (3, "http://x.net/fr/9", None),
        (4, "http://b.org/1", "<meta http-equiv='refresh' content='0; url=http://c.org/1'>"),
        (5, "http://c.org/1?utm_source=x", link.format("http://y.net/es/1")),
        (6, "http://c.org/1", link.format("http://ok.com/")),          # and to an allowed one
        (7, "http://ok.com/", None), (8, "http://y.net/es/1", None),
        (9, "http://z.org/", None), (9, "http://z.org/", None), (10, None, "<link rel=canonical href=/x>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1))
    got = {(r["page_id"]): r["verdict"] for r in urlfilter.filter_urls(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow",
                   8: "block", 9: "allow", 10: "allow"}
    given_ = spark.createDataFrame([("http://z.org/", "http://x.net/fr/9")], "from_url string, to_url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.filter_urls(pages, redirects=given_).collect()}
    assert got[9] == "block"
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0


LINKS = ["http://x.net/es/1", "//x.net/es/1", "/es/1", "1", "./1", "../es/1", "../../../es/./1", "?a=b#c", "#top",
         "HTTPS://x.net/es/1", "mailto:a@b.c", "javascript:go()", "es/../1", "..", ".", "a/..", "/", "", "x:1"]


def test_link_targets_against_the_public_resolver(spark):
    from urllib.parse import urljoin

    urls = ["http://x.net/es/2", "https://x.net", "http://x.net/", "http://x.net/a/b/c.html?q=/z#f", "http://x.net/a/"]
    cases = [(u, t) for u in urls for t in LINKS if t]
    got = spark.createDataFrame(cases, "url string, target string").withColumn(
        "r", urlfilter.resolved(F.col("url"), F.col("target"))).collect()
    for r in got:
        whole = urljoin(r["url"], r["target"])
        if ":" in r["target"] and "//" not in r["target"]:
            assert r["r"] is None, r
            continue
        # a fragment or query alone keeps the page; case of the scheme is no matter
        want = urlfilter.canonical_form(F.lit(whole))
        assert spark.range(1).select(want == urlfilter.canonical_form(F.lit(r["r"]))).first()[0] or \
            (r["target"] == "#top" and r["r"].split("?")[0].split("#")[0] == whole.split("?")[0].split("#")[0]), (r, whole)


def test_every_link_of_a_page_counts(spark, tmp_path):
    import duckdb

    from quarry.llm.oracle import oracle_sql

    rows = [(1, "http://x.net/1", "<link rel=canonical href=/es/1>"), (2, "http://x.net/es/1", None),
            (3, "http://m.org/a", '<link rel="canonical" href="http://m.org/b"><p><link href="../fr/../q/2" '
                                  'rel="canonical"><LINK rel=stylesheet href="http://ok.com/">'),
            (4, "http://m.org/b", "<link rel=canonical href='//y.net/fr/9'>"), (5, "http://m.org/q/2", None),
            (6, "no scheme", "<link rel=canonical href=/es/1>"), (7, "http://n.org/", "<link rel=canonical href=''>"),
            (8, "http://n.org/7", "<meta http-equiv=refresh content='5; url=../es/1'>"
                                  "<meta http-equiv=refresh content='5; url=http://x.net/es/3'>"), (9, None, None)]
    rows += [(100 + i, f"http://w.org/p{i}/q", f"<link rel=canonical href={t!r}>") for i, t in enumerate(LINKS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(pages).collect()}
    assert {i: got[i]["verdict"] for i in range(1, 10)} == {
        1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "block", 9: "allow"}
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = c.execute(oracle_sql()["op10_url_filters"]).df().set_index("page_id")
    for i, r in got.items():
        for name in ("host", "path", "rule", "verdict", "alias_class"):
            a, b = r[name], want.loc[i, name]
            assert a == (None if pd.isna(b) else b), (i, name, a, b)


def test_decontamination_in_item_blocks_and_with_a_sampled_fit(spark, monkeypatch):
    """Items searched block by block, the space fitted on a few passages: the
    same leaks as brute force finds; an answer column decides paraphrases."""
    docs, items = frame(spark, "documents"), frame(spark, "benchmark")
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(decontaminate, "FIT_PASSAGES", 500)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    bench = [tuple(r) for r in items.collect()]
    want = brute_leaks(rows, bench)
    assert whole == want and len(got & want) >= 0.97 * len(want) and got <= want
    clean = {r["doc_id"] for r in decontaminate.clean_documents(docs, items).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in got}


def test_decontamination_awkward(spark):
    words = [f"word{i}" for i in range(40)]
    item = " ".join(words)
    changed = " ".join("x" if i % 10 in (2, 5, 8) else w for i, w in enumerate(words))     # 70 % of the words
    filler = " ".join(f"f{i % 313}g{i % 7}" for i in range(60_000))
    rows = [(1, filler + " " + item + " " + filler), (2, "so " + changed + " it is"), (3, None), (4, ""),
            (4, item), (4, item), (None, item), (5, filler)]
    docs = spark.createDataFrame([(d, t, 1, "y") for d, t in rows],
                                 "doc_id long, text string, item_id int, answer string")
    for answer, paraphrase in (("word0 word1", True), ("nowhere to be seen", False)):
        bench = spark.createDataFrame([(7, item, answer, 1), (8, None, None, 1), (9, "", None, 1), (7, item, answer, 1)],
                                      "item_id long, text string, answer string, doc_id int")
        got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect())
        assert got == sorted([(1, 7), (4, 7), (4, 7), (0, 7)] * 2 + [(2, 7)] * 2 * paraphrase)
        clean = decontaminate.clean_documents(docs, bench)
        assert clean.columns == docs.columns
        assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5] if paraphrase else [2, 3, 4, 5]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == len(rows)


def test_fit_stays_in_few_tasks(spark, monkeypatch):
    """Each task of the fit sends a part of full size, so their number stays
    bounded where exchanges have more partitions than asked for."""
    docs = documents(spark, [(i, f"text {i}") for i in range(300)])
    kind = type(docs)
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, n, *by: plain(df, 40, *by))
    got = decontaminate.fit_sample(docs, 300)
    assert got.rdd.getNumPartitions() <= decontaminate.FIT_TASKS and got.count() == 300


def test_fit_takes_every_passage(spark, monkeypatch):
    """B = A'(A O) of all texts, however many passages; only a sample's before."""
    rnd = random.Random(5)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.5)) % 900}" for _ in range(rnd.choice((1, 15, 16, 33, 700))))
             for _ in range(60)]
    docs = documents(spark, [*enumerate(texts), (70, ""), (71, None)])
    monkeypatch.setattr(decontaminate, "FIT_PASSAGES", 40)
    df, n = decontaminate.passage_frequencies(docs)
    idf = decontaminate.idf_of(df, n)
    for part in (1 << 19, 64):                   # passages of a slice in one part or in several
        monkeypatch.setattr(decontaminate, "SLICE", part)
        got = decontaminate.sketch_product(decontaminate.fit_sample(docs, n), idf)
        o, want = decontaminate._gaussian().astype(np.float64), np.zeros(got.shape)
        seen = 0
        for t in texts:
            h, _ = decontaminate._hashes(Texts(pa.array([t]), lower=True))
            term = decontaminate._terms(h)
            for x in (term[i:i + 16] for i in range(0, len(term), 16)):
                w = idf[x].astype(np.float64)
                np.add.at(want, x, w[:, None] * (w @ o[x] / (w @ w)))
                seen += 1
        assert seen == n > 500
        assert np.abs(got - want).max() < 1e-5 * np.abs(want).max()
