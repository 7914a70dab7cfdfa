"""Temporal split of a paragraph table and its citation edges into corpus,
test queries, relevance judgements and training queries.

Edges stay in long form throughout (one row per citation); lists are built
only for output formats that need them.  Every step is a join or an
aggregation keyed by paragraph id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TEST_YEARS, TRAIN_BEFORE_YEAR, VAL_YEARS
from ..functions.text import text_as_string
from ..session import materialize


def paragraph_year(paragraphs: DataFrame, date_col: str = "date") -> DataFrame:
    return paragraphs.withColumn("year", F.year(F.to_date(F.col(date_col))).cast("long"))


def split_label(year_col="year", train_before: int = TRAIN_BEFORE_YEAR,
                val_years=VAL_YEARS, test_years=TEST_YEARS):
    y = F.col(year_col) if isinstance(year_col, str) else year_col
    return (F.when(y < train_before, F.lit("train"))
             .when(y.isin(list(val_years)), F.lit("val"))
             .when(y.isin(list(test_years)), F.lit("test")))


def temporal_split(paragraphs: DataFrame, date_col: str = "date", **years) -> DataFrame:
    """Adds ``year`` and ``split`` (train / val / test, or null: a null date
    or a year after the test years is in no split)."""
    p = paragraph_year(paragraphs, date_col)
    return p.withColumn("split", split_label("year", **years))


def assert_unique(df: DataFrame, key: str) -> None:
    """Raise when ``key`` repeats (lookups by id must not pick a row)."""
    dup = df.groupBy(key).count().filter(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"{key} is not unique, e.g. {dup[0][key]!r}")


def citations_by_source(edges: DataFrame) -> DataFrame:
    """Targets per citing paragraph, duplicates kept, ascending; null sources
    are dropped."""
    e = edges.filter(F.col("par_id_from").isNotNull())
    return e.groupBy("par_id_from").agg(
        F.sort_array(F.collect_list("par_id_to")).alias("targets"),
        F.count(F.lit(1)).alias("n_targets"))


def edge_source_year(edges: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Each edge with the citing paragraph's year (null when unknown)."""
    years = paragraph_year(paragraphs).select(F.col("par_id").alias("par_id_from"), "year")
    return edges.join(years, "par_id_from", "left")


def queries_from_edges(paragraphs: DataFrame, edges: DataFrame,
                       null_text: str = "") -> DataFrame:
    """Paragraphs that cite something, as (query_id, query_text)."""
    src = edges.select(F.col("par_id_from").alias("par_id"))
    return paragraphs.join(src, "par_id", "left_semi").select(
        F.col("par_id").alias("query_id"), text_as_string("text", null_text).alias("query_text"))


def test_sources(edges: DataFrame, paragraphs: DataFrame, **years) -> DataFrame:
    """Citing paragraphs from the test years (one row each)."""
    sy = edge_source_year(edges, paragraphs).withColumn("split", split_label("year", **years))
    return sy.filter(F.col("split") == "test").select("par_id_from").distinct()


def drop_within_test_queries(edges: DataFrame, paragraphs: DataFrame, **years) -> DataFrame:
    """Test-year sources, minus every source with ANY target in the test
    years (the whole query goes, not just the edge)."""
    split = temporal_split(paragraphs, **years)
    test_pars = split.filter(F.col("split") == "test").select(F.col("par_id").alias("par_id_to"))
    offending = edges.join(test_pars, "par_id_to", "left_semi").select("par_id_from")
    return test_sources(edges, paragraphs, **years).join(offending, "par_id_from", "left_anti")


def candidate_corpus(paragraphs: DataFrame, null_text: str = "", **years) -> DataFrame:
    """Train + validation paragraphs as (doc_id, text): one filtered scan."""
    split = temporal_split(paragraphs, **years)
    return split.filter(F.col("split").isin("train", "val")).select(
        F.col("par_id").alias("doc_id"), text_as_string("text", null_text).alias("text"))


def qrels_to_corpus(edges: DataFrame, kept_sources: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id) for kept sources' targets inside the corpus;
    distinct, so sources left without a target drop out."""
    e = edges.join(kept_sources, "par_id_from", "left_semi")
    e = e.join(corpus.select(F.col("doc_id").alias("par_id_to")), "par_id_to", "left_semi")
    return e.select(F.col("par_id_from").alias("query_id"),
                    F.col("par_id_to").alias("doc_id")).distinct()


def queries_with_qrels(paragraphs: DataFrame, qrels: DataFrame, null_text: str = "") -> DataFrame:
    """Only judged queries, as (query_id, query_text)."""
    judged = qrels.select(F.col("query_id").alias("par_id"))
    return paragraphs.join(judged, "par_id", "left_semi").select(
        F.col("par_id").alias("query_id"), text_as_string("text", null_text).alias("query_text"))


def train_edges(edges: DataFrame, paragraphs: DataFrame, **years) -> DataFrame:
    """Edges whose citing paragraph is from the training years (all targets,
    any year, raw ids, duplicates kept)."""
    sy = edge_source_year(edges, paragraphs).withColumn("split", split_label("year", **years))
    return sy.filter(F.col("split") == "train").select("par_id_from", "par_id_to")


def train_queries(edges: DataFrame, paragraphs: DataFrame, null_text: str = "",
                  **years) -> DataFrame:
    """(query_id, query_text, relevant_docs, n_relevant) for training-year
    sources that exist in the paragraph table."""
    te = train_edges(edges, paragraphs, **years)
    lists = citations_by_source(te)
    p = paragraphs.select(F.col("par_id").alias("par_id_from"),
                          text_as_string("text", null_text).alias("query_text"))
    out = lists.join(p, "par_id_from")
    return out.select(F.col("par_id_from").alias("query_id"), "query_text",
                      F.col("targets").alias("relevant_docs"),
                      F.col("n_targets").alias("n_relevant"))


def labelled_edges(paragraphs: DataFrame, edges: DataFrame, validate: bool = False,
                   **years) -> tuple[DataFrame, DataFrame]:
    """(labels(par_id, split), ends(par_id_from, par_id_to, from, to)): the split
    of every paragraph and of both ends of every edge with a source, ids only,
    each written once.  ``validate`` raises on repeated paragraph ids."""
    labels = materialize(temporal_split(paragraphs, **years).select("par_id", "split"), "labels")
    if validate:
        assert_unique(labels, "par_id")
    source = labels.select(F.col("par_id").alias("par_id_from"), F.col("split").alias("from"))
    target = labels.select(F.col("par_id").alias("par_id_to"), F.col("split").alias("to"))
    ends = edges.filter(F.col("par_id_from").isNotNull()).join(source, "par_id_from", "left") \
        .join(target, "par_id_to", "left").select("par_id_from", "par_id_to", "from", "to")
    return labels, ends


def prepare_retrieval_task(paragraphs: DataFrame, edges: DataFrame, validate: bool = True,
                           null_text: str = "", **years) -> dict[str, DataFrame]:
    """corpus, test queries, qrels, training queries and validation queries.
    Paragraph ids must be unique; ``validate`` raises where they aren't.

    All follow from one label table and one table of edge ends; texts are
    joined to the ids that are left."""
    labels, ends = labelled_edges(paragraphs, edges, validate, **years)
    ends = materialize(ends, "edge_ends")
    test = ends.filter(F.col("from") == "test")
    within = test.filter(F.col("to") == "test").select("par_id_from")
    kept = test.select("par_id_from").distinct().join(within, "par_id_from", "left_anti")
    qrels = materialize(
        test.filter(F.col("to").isin("train", "val")).join(within, "par_id_from", "left_anti")
        .select(F.col("par_id_from").alias("query_id"), F.col("par_id_to").alias("doc_id")).distinct(), "qrels")
    val = ends.filter(F.col("from") == "val")
    lists = citations_by_source(ends.filter(F.col("from") == "train"))
    texts = paragraphs.select(F.col("par_id").alias("query_id"), text_as_string("text", null_text).alias("query_text"))
    train = lists.join(texts.withColumnRenamed("query_id", "par_id_from"), "par_id_from").select(
        F.col("par_id_from").alias("query_id"), "query_text", F.col("targets").alias("relevant_docs"),
        F.col("n_targets").alias("n_relevant"))
    return {"corpus": candidate_corpus(paragraphs, null_text, **years),
            "queries": queries_with_qrels(paragraphs, qrels, null_text), "qrels": qrels, "train_queries": train,
            "val_queries": queries_from_edges(paragraphs, val, null_text),
            "split": temporal_split(paragraphs, **years), "kept_sources": kept}


def split_counts(task: dict[str, DataFrame], edges: DataFrame, paragraphs: DataFrame,
                 **years) -> DataFrame:
    """Row counts per stage, as one (stage, n) table.

    The split label of every paragraph and both ends of every edge are written
    once (ids only); all stages are aggregations of these two tables."""
    labels, ends = labelled_edges(paragraphs, edges, **years)
    # per citing paragraph: is any target in the test years, which distinct
    # targets lie in the corpus
    to = F.when(F.col("to").isin("train", "val"), F.col("par_id_to"))
    per = materialize(ends.filter(F.col("from").isin("train", "test")).groupBy("par_id_from", "from")
                      .agg(F.max(F.coalesce((F.col("to") == "test").cast("int"), F.lit(0))).alias("within"),
                           F.count_distinct(to).alias("judged")), "sources")
    test = F.col("from") == "test"
    kept = test & (F.col("within") == 0)

    a = per.select(F.explode(F.array(
        F.struct(F.lit("test_sources").alias("stage"), test.cast("long").alias("n")),
        F.struct(F.lit("kept_test_sources").alias("stage"), kept.cast("long").alias("n")),
        F.struct(F.lit("test_queries").alias("stage"), (kept & (F.col("judged") > 0)).cast("long").alias("n")),
        F.struct(F.lit("qrels").alias("stage"), F.when(kept, F.col("judged")).otherwise(0).alias("n")),
        F.struct(F.lit("train_queries").alias("stage"), (F.col("from") == "train").cast("long").alias("n")),
    )).alias("x")).select("x.stage", "x.n")
    b = labels.filter(F.col("split").isNotNull()).select(
        F.concat("split", F.lit("_paragraphs")).alias("stage"), F.lit(1).cast("long").alias("n"))
    c = labels.filter(F.col("split").isin("train", "val")).select(
        F.lit("corpus").alias("stage"), F.lit(1).cast("long").alias("n"))
    return a.unionByName(b).unionByName(c).groupBy("stage").agg(F.sum("n").alias("n"))
