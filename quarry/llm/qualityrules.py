"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document's metrics are computed inside its row (no exchange of text).
Every metric is a whole number of thousandths, so a histogram by value is a
quantile sketch with a resolution of 1/1000 that merges by adding counts:
one per (lang, source), merged into one per lang and one for all.  The
limit of a metric is its median plus a spread: twice the distance from the
median to an upper quantile, at least that distance plus ``guard``.  A tail
that goes on as it began stays, what lies apart from it goes.

A source full of junk would raise its own quantile, so a group's spread is at
most 3/2 of the middle spread among the sources of its language, every source
counted once, however many documents it has.  Those spreads are whole numbers,
so their histogram by language is again a mergeable sketch.  What is usual in
a source (its median) stays usual.  A group with fewer than ``min_docs``
documents takes its language's limit, a language with fewer takes that of all
documents, both under the same ceilings.  A document that exceeds any limit of
its group is rejected.

Histograms are aggregated on the map side (a hot source costs at most 1001
rows per metric and task); thresholds are one row per group and are joined to
the metrics, which carry no text.

Defined results: a null text has no words (and fails the base rules); a null
lang or source is a group of its own; an empty table gives an empty result;
repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: metric: (upper quantile in per cent, guard in thousandths of the base).  The
#: guard is about one symbol in a line, one line of a page, or one sentence.
METRICS = {
    "symbols": (90, 10),     # symbols per word character
    "dup_lines": (98, 50),   # lines equal to an earlier line
    "repeats": (98, 30),     # words in repeated 3-word windows
    "shouting": (98, 10),    # A-Z and ! per word character
}
#: A group with fewer documents doesn't show its upper quantiles.
MIN_DOCS = 100
MIN_WORDS = 50
UPPER_BANG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"


def base_metrics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The base columns and the metrics of each document."""
    keep = tuple(c for c in keep if c not in ("doc_id", "lang", "source"))
    d = docs.select("doc_id", "lang", "source", *keep,
                    F.coalesce(F.col("text"), F.lit("")).alias("__t"))
    d = d.select("doc_id", "lang", "source", *keep, "__t",
                 F.array_remove(F.split("__t", SPLIT), "").alias("__w"),
                 F.translate("__t", SPACES, "").alias("__solid"),
                 F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
                 .alias("__lines"))
    d = d.select("doc_id", "lang", "source", *keep, "__w",
                 F.size("__w").cast("long").alias("n_words"),
                 F.length("__solid").cast("long").alias("word_chars"),
                 (F.length("__solid") - F.length(F.translate("__solid", SYMBOLS, "")))
                 .cast("long").alias("n_symbols"),
                 F.size("__lines").cast("long").alias("__n_lines"),
                 (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")
                 .alias("n_dup_lines"),
                 (F.length("__solid") - F.length(F.translate("__solid", UPPER_BANG, "")))
                 .cast("long").alias("__upper"))
    rest = [c for c in d.columns if c != "__w"]
    # 3-word windows; their positions are sorted by window only where one repeats
    d = d.select(*rest, F.expr(
        "CASE WHEN n_words >= 3 THEN transform(sequence(0, size(__w) - 3), "
        "i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) ELSE array() END").alias("__g"))
    d = d.select(*rest, F.expr(
        "CASE WHEN size(array_distinct(__g)) < size(__g) "
        "THEN array_sort(transform(__g, (g, i) -> struct(g, i))) END").alias("__s"))
    d = d.select(*rest, F.expr(
        "array_sort(transform(filter(__s, (x, i) -> (i > 0 AND get(__s, i - 1).g = x.g) OR "
        "(get(__s, i + 1).g = x.g)), x -> x.i))").alias("__p"))
    return d.select(*rest, F.expr(
        "CASE WHEN __p IS NULL THEN 0L ELSE aggregate(sequence(1, size(__p) - 1), 3L, "
        "(a, i) -> a + least(3, __p[i] - __p[i - 1])) END").alias("n_repeat_words"))


def with_metrics(d: DataFrame) -> DataFrame:
    def per_mille(num: str, den: str):
        return F.least(F.lit(1000), F.floor(
            F.lit(1000) * F.col(num) / F.greatest(F.lit(1), F.col(den)))).cast("int")

    return d.withColumns({
        "symbols": per_mille("n_symbols", "word_chars"),
        "dup_lines": per_mille("n_dup_lines", "__n_lines"),
        "repeats": per_mille("n_repeat_words", "n_words"),
        "shouting": per_mille("__upper", "word_chars"),
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))})


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, metric, value, n): the histogram of each group."""
    values = F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))]))
    return rows.filter(~F.col("base_failed")).select("lang", "source", values) \
        .groupBy("lang", "source", F.col("key").alias("metric"), "value") \
        .agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "metric", "value").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, docs, mid, spread).  A sketch has at most 1001 values per metric,
    gathered and read in order."""
    top, guard = F.lit(None).cast("int"), F.lit(None).cast("int")
    for m, (q, g) in METRICS.items():
        top = F.when(F.col("metric") == m, F.lit(q)).otherwise(top)
        guard = F.when(F.col("metric") == m, F.lit(g)).otherwise(guard)
    hist = sketch.groupBy(*by, "metric").agg(
        F.array_sort(F.collect_list(F.struct("value", "n"))).alias("h"), F.sum("n").alias("docs"))
    hist = hist.withColumns({"__top": top, "__guard": guard})
    hist = hist.select(*by, "metric", "docs", "__guard", _quantile("h", "docs", "50").alias("mid"),
                       _quantile("h", "docs", "__top").alias("q"))
    far = F.col("q") - F.col("mid")
    return hist.select(*by, "metric", "docs", "mid", (far + F.greatest(F.col("__guard"), far)).alias("spread"))


def _quantile(h: str, total: str, per_cent: str):
    """The least value of a sorted histogram that covers ``per_cent`` of it."""
    return F.expr(
        f"aggregate({h}, named_struct('c', 0L, 'v', -1), (a, x) -> named_struct("
        f"'c', a.c + x.n, 'v', CASE WHEN a.v < 0 AND (a.c + x.n) * 100 >= {total} * {per_cent} "
        "THEN x.value ELSE a.v END)).v")


def ceilings(group_limits: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, cap): 3/2 of the middle spread, each group counted once."""
    sketch = group_limits.groupBy(*by, "metric", F.col("spread").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    hist = sketch.groupBy(*by, "metric").agg(
        F.array_sort(F.collect_list(F.struct("value", "n"))).alias("h"), F.sum("n").alias("groups"))
    return hist.select(*by, "metric",
                       F.floor(_quantile("h", "groups", "50") * 3 / 2).cast("int").alias("cap"))


def thresholds(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per (lang, source): the limit of every metric."""
    own = materialize(sketches(rows), "quality_sketches")
    by_source = materialize(limits(own, ["lang", "source"]), "quality_limits")
    large = by_source.filter(F.col("docs") >= min_docs)
    langs = limits(merge(own, ["lang"]), ["lang"])
    lang_caps = ceilings(large, ["lang"]).withColumnRenamed("lang", "__lang")
    langs = langs.withColumnRenamed("lang", "__l").join(
        lang_caps.withColumnRenamed("metric", "__m"),
        F.col("__l").eqNullSafe(F.col("__lang")) & (F.col("metric") == F.col("__m")), "left")
    langs = materialize(langs.select(F.col("__l").alias("lang"), "metric", "docs", "mid", "spread", "cap"),
                        "quality_lang_limits").alias("l")
    overall = limits(merge(own, []), []).join(ceilings(large, []), "metric", "left")
    overall = materialize(overall, "quality_overall_limits").alias("a")
    groups = rows.select("lang", "source").distinct().select(
        "lang", "source", F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric")).alias("g")
    s = by_source.alias("s")
    same = F.col("g.lang").eqNullSafe(F.col("s.lang")) & F.col("g.source").eqNullSafe(
        F.col("s.source")) & (F.col("g.metric") == F.col("s.metric"))
    t = groups.join(s, same, "left") \
        .join(langs, F.col("g.lang").eqNullSafe(F.col("l.lang"))
              & (F.col("g.metric") == F.col("l.metric")), "left") \
        .join(overall, F.col("g.metric") == F.col("a.metric"), "left")
    # least() skips nulls: without a group of min_docs there is no ceiling
    lim = F.when(F.col("s.docs") >= min_docs, F.col("s.mid") + F.least("s.spread", "l.cap")) \
        .when(F.col("l.docs") >= min_docs, F.col("l.mid") + F.least("l.spread", "l.cap")) \
        .otherwise(F.col("a.mid") + F.least("a.spread", "a.cap"))
    t = t.select("g.lang", "g.source", "g.metric", lim.alias("lim"))
    return t.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("metric") == m, F.col("lim"))).alias(f"max_{m}") for m in METRICS])


def judge(docs: DataFrame, keep: tuple[str, ...] = (), min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, base columns, base_failed, kept, metrics and thresholds, then
    the columns named in ``keep``."""
    rows = with_metrics(materialize(base_metrics(docs, keep), "quality_metrics"))
    t = materialize(thresholds(rows, min_docs), "quality_thresholds").alias("t")
    r = rows.alias("r")
    j = r.join(t, F.col("r.lang").eqNullSafe(F.col("t.lang"))
               & F.col("r.source").eqNullSafe(F.col("t.source")), "left")
    passed = F.lit(True)
    for m in METRICS:
        passed = passed & (F.col(m) <= F.coalesce(F.col(f"max_{m}"), F.lit(1000)))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", (~F.col("base_failed") & passed).alias("kept"),
                    *METRICS, *[f"max_{m}" for m in METRICS], *[f"r.{c}" for c in keep])
