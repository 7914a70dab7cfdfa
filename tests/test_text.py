import random

from pyspark.sql import functions as F

from quarry.functions.text import (ngram_range, remove_stop_words, tokenize,
                                   word_ngrams)

WS = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_tokenize_matches_python_split(spark):
    rnd = random.Random(3)
    alphabet = ["a", "B", "é", "Σ", "İ", "x", "-", ".", "​"] + WS
    texts = [None, "", "   ", " 　", "İstanbul ΣΑΣ", "a​b"]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.tk for r in df.select("i", tokenize("t").alias("tk")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else t.lower().split()), repr(t)


def test_ngrams_and_stop_words(spark):
    df = spark.createDataFrame([("a b c d",), ("a",), ("",), ("x the y",)], "t string")
    rows = df.select(word_ngrams(tokenize("t"), 2).alias("g2"), word_ngrams(tokenize("t"), 3).alias("g3"),
                     ngram_range(remove_stop_words(tokenize("t"), ["the"]), 1, 2).alias("r")).collect()
    assert rows[0].g2 == ["a b", "b c", "c d"] and rows[0].g3 == ["a b c", "b c d"]
    assert rows[1].g2 == [] and rows[2].g3 == []
    assert rows[3].r == ["x", "y", "x y"]  # stop words go before n-grams
