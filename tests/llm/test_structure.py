"""Conversation repair and ranked search against brute force."""
import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import SF001, SF01

from quarry.llm import bestposition, turnrepair

CONV = "conv_id long, turn long, role string, text string, lang string, cn int, pid long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, 7) for r in rows], CONV)


def awkward_conversations():
    rnd = random.Random(5)
    texts = ["Fine.", "open end", "", " \n", "Why?", "so!  ", "Fine.", "é ü", None]
    rows = [(c, None if rnd.random() < 0.1 else rnd.randrange(12),
             rnd.choice(["user", "assistant", "system", "tool", "u2", "", None]), rnd.choice(texts))
            for c in range(60) for _ in range(rnd.randrange(1, 9))]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (None, None, None, None)]
    rows += [(900, None, "user", "All turns null."), (901, 3, "user", "x" * 200_000 + ".")]
    rows += [(902, 1, "user", "Copies."), (902, 1, "user", "Copies.")] * 5
    return rows


def repaired(spark, rows):
    return sorted((tuple(r) for r in turnrepair.repair(turnrepair.damage(conversations(spark, rows)))
                   .collect()), key=repr)


def test_awkward_conversations(spark):
    rows = awkward_conversations()
    assert repaired(spark, rows) == sorted(brute.conversations(rows), key=repr)


def test_no_conversations(spark):
    assert repaired(spark, []) == []


@pytest.mark.parametrize("folder", [SF001, SF01])
def test_conversations_against_brute_force(spark, folder):
    c = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = turnrepair.repair(turnrepair.damage(c)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        brute.conversations([tuple(r) for r in c.collect()]), key=repr)


def test_long_conversation_in_many_segments(spark, monkeypatch):
    """Segments of 7 rows: borders, entries and exits in every state."""
    monkeypatch.setattr(turnrepair, "SEGMENT", 7)
    rnd = random.Random(9)
    rows = [(1, i // 2, rnd.choice(["user", "assistant", "user", "system", "x"]),
             rnd.choice([f"Text {i}.", f"text {i}", "", "Same."])) for i in range(150)]
    rows += [(2, i, "user", f"Row {i}.") for i in range(60)]
    assert repaired(spark, rows) == sorted(brute.conversations(rows), key=repr)


def test_hot_conversation(spark):
    """All rows in one conversation, most of them copies of one row."""
    rows = [(1, 4, "user", "Again."), (1, 2, "assistant", "More.")] * 3000 + [
        (1, i, "user" if i % 2 else "assistant", f"T{i}.") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = turnrepair.repair(df).collect()
    assert got["duplicate"] == 5998 and got["audit"].count("D") >= 5998
    assert len(got["audit"]) == got["audit"].count("I") + 6500
    turns = [tuple(r) for r in turnrepair.repaired(df).orderBy("position").select("role", "text").collect()]
    roles = "".join(r[0][0] for r in turns)
    assert re.fullmatch("(s?(ua)+)?", roles)
    import hashlib
    assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest() \
        == got["repaired_sha256"]


def test_ranks_order_nodes_by_their_audit():
    """Prefix-doubling ranks against the audits themselves."""
    rnd = np.random.default_rng(3)
    kind, fault = rnd.integers(0, 4, 40).astype(np.int32), rnd.integers(0, 4, 40).astype(np.int32)
    nodes = turnrepair.Nodes(kind, fault, np.array([0, 25, 40]), np.array([turnrepair.LAST] * 2),
                             np.array([True, True]))
    edit, ahead = nodes.steps()

    def audit(v):
        out = ""
        while edit[v]:
            out += " DIKR"[edit[v]]
            v = ahead[v]
        return out

    audits = [audit(v) for v in range(len(edit))]
    rank = nodes.ranks()
    order = sorted(set(audits))
    assert [order.index(a) for a in audits] == rank.tolist()
    codes, offs, _ = nodes.paths(np.arange(len(edit)))
    text = bytes(codes).decode().translate(str.maketrans("uaUA", "RRII"))
    assert [text[a:z] for a, z in zip(offs, offs[1:])] == audits


# ------------------------------------------------------------ ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in wanted.items():
        scored = []
        for d, c in counted:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def awkward_docs():
    rnd = random.Random(4)
    words = "the a of Été ñu x1 2y zz qq long-tail İstanbul  nb under_score".split(" ")
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 30)))) for i in range(150)]
    docs += [(3, "the same id"), (3, "the same id"), (None, "the null id"), (500, None), (501, ""),
             (502, "-_- ..."), (503, "zz qq " * 40_000), (504, "The THE the\0the")]
    return docs


def test_awkward_search(spark):
    docs = awkward_docs()
    items = [(1, "the zz"), (2, "Été, ñu? İstanbul"), (3, None), (4, "..."), (5, "nowhere"), (1, "x1 the"),
             (None, "qq under score"), (6, "a of the a"), (6, "a of the a")]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, n int")
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    for k in (3, 50):
        got = bestposition.search(d.repartition(3), q, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
        assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items, k)
    assert bestposition.search(d.limit(0), q).count() == 0 and bestposition.search(d, q.limit(0)).count() == 0


def test_search_in_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(bestposition, "MAX_BYTES", 4000)
    monkeypatch.setattr(bestposition, "CHUNK", 500)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = spark.read.parquet(f"{SF001}/benchmark.parquet")
    rows = [[tuple(r) for r in f.collect()] for f in (docs.select("doc_id", "text"), items)]
    got = bestposition.search(docs.repartition(3), items, 10)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(*rows, 10)


def test_best_positions_stop_early_and_lose_nothing():
    """One list decides; the others are read to a fraction of their length."""
    rnd = np.random.default_rng(1)
    n = 20_000
    has = rnd.random((n, 4)) < np.array([0.002, 0.5, 0.7, 0.9])
    sizes, term = has.sum(axis=1), np.nonzero(has)[1]
    tf = rnd.integers(1, 4, len(term))
    length = rnd.integers(50, 60, n)
    weight = np.array([6000, 20, 10, 5])
    lists = bestposition.Lists(length, sizes, term, tf, weight, n, int(length.sum()))
    want = np.bincount(np.repeat(np.arange(n), sizes), weights=lists.value, minlength=n).astype(np.int64)
    row, score, read = bestposition.best_positions(lists, np.arange(4), 10, 0)
    assert (want[row] == score).all() and read < 0.2 * len(term)
    tenth = np.sort(want)[-10]
    assert set(np.flatnonzero(want >= tenth)) <= set(row.tolist())
    # equal scores at the bound are read on
    flat = bestposition.Lists(np.full(n, 50), np.ones(n, dtype=int), np.zeros(n, dtype=int),
                              np.ones(n, dtype=int), np.array([100]), n, 50 * n)
    assert len(bestposition.best_positions(flat, np.array([0]), 10, 0)[0]) == n
