"""Registered queries: one per operator of the inventory, each a function
(spark, sf_dir) -> DataFrame over the driver tables (or tables Spark derives
from them).  Outputs are scalar columns with explicit names; floating point
results are rounded to 6 decimals so that an independent SQL engine can be
compared value by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EVAL_K_VALUES
from ..functions.text import remove_stop_words, tokenize, word_ngrams
from ..operators import dense, evaluate, lexical, pairs, ranking, saved_index, split, training, vector_index
from ..session import materialize, scratch_path
from ..sources import files
from . import tasks

ROUND = 6


def _r(c, name: str | None = None):
    col = F.round(F.col(c) if isinstance(c, str) else c, ROUND)
    return col.alias(name or (c if isinstance(c, str) else None))


def _md5(c):
    return F.md5(F.coalesce(F.col(c), F.lit("")))


def _ids(c):
    """A sorted id list as text: '3 7 7 12'."""
    return F.array_join(F.sort_array(F.col(c)), " ")


# ----------------------------------------------------------- shared inputs

def _lexical(spark, sf):
    return (tasks.lexical_corpus(spark, sf), tasks.lexical_queries(spark, sf),
            tasks.lexical_qrels(spark, sf))


def _bm25_run(spark, sf):
    return lexical.bm25_scores(lexical.bm25_index(tasks.lexical_corpus(spark, sf)), tasks.lexical_queries(spark, sf))


def _tfidf_run(spark, sf, ngram):
    return lexical.tfidf_scores(lexical.tfidf_index(tasks.lexical_corpus(spark, sf), ngram=ngram),
                                tasks.lexical_queries(spark, sf))


def _temporal(spark, sf):
    par = tasks.paragraphs(spark, sf)
    edges = tasks.citations(spark, sf)
    return par, edges, split.prepare_retrieval_task(par, edges, validate=True)


def _score(c="score"):
    """Scores leave at float32 precision -- the precision rankings compare
    at -- so engines that sum in different orders print the same value."""
    return F.col(c).cast("float").alias(c)


def _run_cols(df):
    return df.select("query_id", "doc_id", "rank", _score())


def _per_query(run, qrels, corpus):
    return evaluate.per_query_metrics(evaluate.qrel_ranks(run, qrels, corpus, run_in_corpus=True))


def _metrics_row(df):
    return df.select(*[_r(c) for c in evaluate.metric_names()], "n_queries")


# ------------------------------------------------------- sources and sinks

def q_read_paragraphs(spark, sf):
    path = scratch_path(spark, "paragraphs_csv")
    files.write_csv(tasks.paragraphs(spark, sf), path)
    return files.read_paragraphs(spark, path)


def q_read_citations(spark, sf):
    path = scratch_path(spark, "citations_csv")
    files.write_csv(tasks.citations(spark, sf), path)
    return files.read_citations(spark, path)


def _write_split_csvs(spark, sf):
    edges = tasks.split_edges(spark, sf)
    paths = {}
    for name in files.SPLIT_NAMES:
        paths[name] = scratch_path(spark, f"edges_{name}")
        files.write_csv(edges.filter(F.col("split") == name).select("par_id_from", "par_id_to"),
                        paths[name])
    return paths


def q_read_split_edges(spark, sf):
    return files.read_split_edges(spark, _write_split_csvs(spark, sf))


def _split_queries_and_corpus(spark, sf):
    from ..operators.splitfiles import (drop_unresolved_edges, paragraphs_on_edges,
                                        queries_by_split)
    edges = files.read_split_edges(spark, _write_split_csvs(spark, sf))
    par = tasks.paragraphs(spark, sf)
    resolved = drop_unresolved_edges(edges, par)
    return queries_by_split(resolved, par), paragraphs_on_edges(resolved, par)


def q_write_jsonl(spark, sf):
    _, corpus = _split_queries_and_corpus(spark, sf)
    path = scratch_path(spark, "corpus_jsonl")
    files.write_jsonl(corpus, path)
    back = files.read_jsonl(spark, path, files.CORPUS_JSONL_SCHEMA)
    return back.select("doc_id", _md5("text").alias("text_md5"))


def q_read_jsonl(spark, sf):
    q, _ = _split_queries_and_corpus(spark, sf)
    out = {}
    for name in files.SPLIT_NAMES:
        out[name] = scratch_path(spark, f"{name}_jsonl")
        files.write_jsonl(q.filter(F.col("split") == name).drop("split", "n_relevant"), out[name])
    parts = [files.read_jsonl(spark, out[n], files.QUERY_JSONL_SCHEMA).withColumn("split", F.lit(n))
             for n in files.SPLIT_NAMES]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.select("split", "query_id", _md5("query_text").alias("query_text_md5"),
                    _ids("relevant_docs").alias("relevant_docs"),
                    F.size("relevant_docs").cast("long").alias("n_relevant"))


SUMMARY_HEADERS = [("method", "Method"), ("recall_at_1", "Recall@1"), ("recall_at_5", "Recall@5"),
                   ("recall_at_10", "Recall@10"), ("recall_at_20", "Recall@20"),
                   ("ndcg_at_10", "nDCG@10"), ("mrr", "MRR"), ("map", "MAP")]


def _dense_ranks(spark, sf):
    return dense.relevant_ranks(tasks.dense_queries(spark, sf), tasks.dense_vectors(spark, sf),
                                tasks.dense_qrels(spark, sf), exclude_self=True)


def _through_csv(spark, summary, name):
    """The summary as text, written to a CSV file and read back."""
    path = scratch_path(spark, name)
    files.write_summary_csv(summary, path, SUMMARY_HEADERS)
    schema = ", ".join(f"`{h}` string" for _, h in SUMMARY_HEADERS)
    return spark.read.schema(schema).option("header", "true").csv(path)


def q_write_summary_csv(spark, sf):
    ranks = _dense_ranks(spark, sf).withColumn("model", F.lit("Dense-cosine"))
    return _through_csv(spark, evaluate.summarize(ranks, ["Dense-cosine"]), "summary_csv")


# ------------------------------------------------- projections / functions

def q_paragraph_year(spark, sf):
    return split.paragraph_year(tasks.paragraphs(spark, sf)).select("par_id", "year")


def q_temporal_split(spark, sf):
    return split.temporal_split(tasks.paragraphs(spark, sf)).select("par_id", "year", "split")


def q_text_as_string(spark, sf):
    from ..functions.text import text_as_string
    p = tasks.paragraphs(spark, sf)
    return p.select("par_id", F.md5(text_as_string("text")).alias("text_md5"),
                    F.length(text_as_string("text")).cast("long").alias("n_chars"))


def q_tokenize(spark, sf):
    d = tasks.lexical_corpus(spark, sf).select("doc_id", tokenize("text").alias("tk"))
    return d.select("doc_id", F.size("tk").cast("long").alias("n_tokens"),
                    F.array_join("tk", " ").alias("tokens"))


def q_drop_unresolved_edges(spark, sf):
    from ..operators.splitfiles import drop_unresolved_edges
    e = drop_unresolved_edges(tasks.split_edges(spark, sf), tasks.paragraphs(spark, sf))
    return e.select("split", "par_id_from", "par_id_to")


def q_remove_stop_words(spark, sf):
    sw = lexical.default_stop_words()
    d = tasks.lexical_corpus(spark, sf).select(
        "doc_id", remove_stop_words(tokenize("text"), sw).alias("tk"))
    return d.select("doc_id", F.size("tk").cast("long").alias("n_tokens"),
                    F.array_join("tk", " ").alias("tokens"))


def q_word_ngrams(spark, sf):
    d = tasks.lexical_corpus(spark, sf).select("doc_id", word_ngrams(tokenize("text"), 2).alias("g"))
    return d.select("doc_id", F.size("g").cast("long").alias("n_ngrams"),
                    F.size(F.array_distinct("g")).cast("long").alias("n_distinct_ngrams"),
                    F.md5(F.array_join("g", "|")).alias("ngrams_md5"))


def q_score_pair_filter(spark, sf):
    """Every scored doc passes the filter; the best 20 of what is left."""
    labelled = tasks.table(spark, sf, "labels").select("doc_id")
    run = ranking.score_pair_filter(_bm25_run(spark, sf), labelled)
    return _run_cols(ranking.top_k_per_query(run, 20))


# ------------------------------------------------------------------- joins

def q_edge_source_year(spark, sf):
    return split.edge_source_year(tasks.citations(spark, sf), tasks.paragraphs(spark, sf)) \
        .select("par_id_from", "par_id_to", "year")


def q_edge_text_lookup(spark, sf):
    from ..operators.splitfiles import edge_text_lookup
    e = edge_text_lookup(tasks.split_edges(spark, sf), tasks.paragraphs(spark, sf))
    return e.select("split", "par_id_from", "par_id_to", _md5("citing_text").alias("citing_md5"),
                    _md5("cited_text").alias("cited_md5"))


def q_queries_from_edges(spark, sf):
    q = split.queries_from_edges(tasks.paragraphs(spark, sf), tasks.citations(spark, sf))
    return q.select("query_id", _md5("query_text").alias("query_text_md5"))


def q_drop_within_test_queries(spark, sf):
    return split.drop_within_test_queries(tasks.citations(spark, sf), tasks.paragraphs(spark, sf))


def q_qrels_to_corpus(spark, sf):
    return _temporal(spark, sf)[2]["qrels"]


def q_queries_with_qrels(spark, sf):
    q = _temporal(spark, sf)[2]["queries"]
    return q.select("query_id", _md5("query_text").alias("query_text_md5"))


def q_term_match_join(spark, sf):
    corpus, queries, _ = _lexical(spark, sf)
    postings = lexical.bm25_index(corpus).postings
    qt = lexical.query_term_counts(queries)
    j = lexical.term_match_join(postings, qt)
    return j.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n_shared_terms"))


def q_query_doc_cross(spark, sf):
    """Each query against every doc, summed up per query."""
    out = dense.score_profiles(tasks.dense_queries(spark, sf), tasks.dense_vectors(spark, sf),
                               exclude_self=True)
    return out.select("query_id", "n_docs", _r("mean_score"), _score("max_score"))


# ------------------------------------------------------------ aggregations

def q_citations_by_source(spark, sf):
    c = split.citations_by_source(tasks.citations(spark, sf))
    return c.select("par_id_from", F.array_join("targets", " ").alias("targets"), "n_targets")


def q_queries_by_split(spark, sf):
    from ..operators.splitfiles import drop_unresolved_edges, queries_by_split
    par = tasks.paragraphs(spark, sf)
    q = queries_by_split(drop_unresolved_edges(tasks.split_edges(spark, sf), par), par)
    return q.select("split", "query_id", _md5("query_text").alias("query_text_md5"),
                    _ids("relevant_docs").alias("relevant_docs"), "n_relevant")


def q_paragraphs_on_edges(spark, sf):
    from ..operators.splitfiles import drop_unresolved_edges, paragraphs_on_edges
    par = tasks.paragraphs(spark, sf)
    c = paragraphs_on_edges(drop_unresolved_edges(tasks.split_edges(spark, sf), par), par)
    return c.select("doc_id", _md5("text").alias("text_md5"))


def q_train_queries(spark, sf):
    t = _temporal(spark, sf)[2]["train_queries"]
    return t.select("query_id", _md5("query_text").alias("query_text_md5"),
                    _ids("relevant_docs").alias("relevant_docs"), "n_relevant")


def q_split_counts(spark, sf):
    par, edges, task = _temporal(spark, sf)
    return split.split_counts(task, edges, par)


def q_corpus_stats(spark, sf):
    idx = lexical.bm25_index(tasks.lexical_corpus(spark, sf))
    ts = idx.term_stats
    return ts.agg(F.count(F.lit(1)).alias("vocab_size"),
                  _r(F.avg("raw_idf"), "mean_raw_idf"),
                  F.sum(F.when(F.col("raw_idf") < 0, 1).otherwise(0)).cast("long")
                  .alias("n_negative_idf"),
                  F.sum("df").cast("long").alias("n_postings")) \
        .select("*", idx.n_docs.cast("long").alias("n_docs"), _r(idx.avgdl, "avgdl"))


def q_top_k_vocabulary(spark, sf):
    corpus = tasks.lexical_corpus(spark, sf)
    idx = lexical.tfidf_index(corpus, ngram=(1, 2))
    return idx.vocab.select("term", "cf", "df")


def q_mean_over_queries(spark, sf):
    corpus, _, qrels = _lexical(spark, sf)
    pq = _per_query(_bm25_run(spark, sf), qrels, corpus)
    return evaluate.mean_over_queries(pq, ["recall_at_10", "rr"]).select(
        _r("recall_at_10"), _r("rr", "mean_rr"))


# ------------------------------------------------ set ops, sorts, rankings

def q_candidate_corpus(spark, sf):
    c = split.candidate_corpus(tasks.paragraphs(spark, sf))
    return c.select("doc_id", _md5("text").alias("text_md5"))


def q_dense_doc_index(spark, sf):
    from ..operators.ordering import dense_index
    c = split.candidate_corpus(tasks.paragraphs(spark, sf)).select("doc_id")
    return dense_index(c, ["doc_id"], "doc_idx")


def q_set_overlap(spark, sf):
    corpus, queries, qrels = _lexical(spark, sf)
    top = ranking.top_k_per_query(_bm25_run(spark, sf), 20).select("query_id", "doc_id")
    found = top.join(qrels, ["query_id", "doc_id"]).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_found"))
    judged = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    return judged.join(found, "query_id", "left").select(
        "query_id", "n_relevant", F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"))


def q_top_k_per_query(spark, sf):
    return _run_cols(ranking.top_k_per_query(_bm25_run(spark, sf), 5))


def q_full_ranking(spark, sf):
    return _run_cols(ranking.full_ranking(_bm25_run(spark, sf)))


def q_batch_retrieve(spark, sf):
    _, _, task = _temporal(spark, sf)
    # the task's parts are each read more than once
    corpus, queries = (materialize(task[p], f"task_{p}") for p in ("corpus", "queries"))
    return _run_cols(lexical.bm25_top(lexical.bm25_index(corpus), queries, 10))


def q_scores_for_all(spark, sf):
    """The zero-filled score table, summed up per query."""
    corpus, queries, _ = _lexical(spark, sf)
    out = ranking.score_profiles(_bm25_run(spark, sf), queries, corpus)
    return out.select("query_id", "n_docs", "n_scored", _score("total"), _score("top"))


# ------------------------------------------------------- retrieval models

def q_bm25_index(spark, sf):
    idx = lexical.bm25_index(tasks.lexical_corpus(spark, sf))
    return idx.postings.select("term", "doc_id", "tf", "dl")


def q_bm25_top_k(spark, sf):
    corpus, queries, _ = _lexical(spark, sf)
    return _run_cols(lexical.bm25_top_k(corpus, queries, 10))


def q_bm25_saved_index(spark, sf):
    """The same rankings from an index on disk: half of the documents indexed
    first, the others added as a segment, query terms pushed to the scan."""
    corpus, queries, _ = _lexical(spark, sf)
    path = scratch_path(spark, "bm25_saved")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    saved_index.add_segment(corpus.filter(half == 0), path, "first")
    saved_index.add_segment(corpus.filter(half == 1), path, "second")
    return _run_cols(saved_index.saved_top_k(saved_index.open_index(spark, path), queries, 10))


def q_tfidf_top_k_1gr(spark, sf):
    corpus, queries, _ = _lexical(spark, sf)
    return _run_cols(lexical.tfidf_top_k(corpus, queries, 10, (1, 1)))


def q_tfidf_top_k_2gr(spark, sf):
    corpus, queries, _ = _lexical(spark, sf)
    return _run_cols(lexical.tfidf_top_k(corpus, queries, 10, (1, 2)))


def q_cosine_top_k(spark, sf):
    return _run_cols(dense.cosine_top_k(tasks.dense_queries(spark, sf),
                                        tasks.dense_vectors(spark, sf), 10, exclude_self=True))


def q_cosine_top_k_block(spark, sf):
    return _run_cols(dense.cosine_top_k_block(tasks.dense_queries(spark, sf),
                                              tasks.dense_vectors(spark, sf), 10,
                                              exclude_self=True))


def q_cosine_top_k_lsh(spark, sf):
    index = vector_index.build_index(tasks.dense_vectors(spark, sf))
    return _run_cols(vector_index.search_index(index, tasks.dense_queries(spark, sf), 10, exclude_self=True))


def q_cosine_index_quality(spark, sf):
    """The approximate search held against the exact one."""
    vectors, queries = tasks.dense_vectors(spark, sf), tasks.dense_queries(spark, sf)
    run, counts = vector_index.search_with_counts(vector_index.build_index(vectors), queries, 10, exclude_self=True)
    q = vector_index.search_quality(run, dense.cosine_top_k(queries, vectors, 10, exclude_self=True), counts,
                                    vectors.select(F.count(F.lit(1))).scalar())
    return q.select("n_queries", "n_rows", (F.col("recall") >= 0.9).alias("recall_from_90_percent"),
                    (F.col("compared_share") <= 0.1).alias("compared_to_10_percent"))


def q_encode_texts(spark, sf):
    vec = dense.encode_texts(tasks.lexical_corpus(spark, sf), "text", "doc_id")
    long = vec.select("doc_id", F.posexplode("vec").alias("dim_idx", "value"))
    return long.filter(F.col("value") != 0).select(
        "doc_id", F.col("dim_idx").cast("long").alias("dim_idx"), _r("value"))


# -------------------------------------------------------------- evaluation

def q_qrel_ranks(spark, sf):
    corpus, _, qrels = _lexical(spark, sf)
    r = evaluate.qrel_ranks(_bm25_run(spark, sf), qrels, corpus, run_in_corpus=True)
    return r.select("query_id", "doc_id", "rank", "block_start", "block_end")


def _lex_pq(spark, sf):
    corpus, _, qrels = _lexical(spark, sf)
    return _per_query(_bm25_run(spark, sf), qrels, corpus)


def q_recall_at_k(spark, sf):
    names = [f"recall_at_{k}" for k in EVAL_K_VALUES]
    return evaluate.mean_over_queries(_lex_pq(spark, sf), names).select(*[_r(c) for c in names])


def q_mrr(spark, sf):
    return evaluate.mean_over_queries(_lex_pq(spark, sf), ["rr"]).select(_r("rr", "mrr"))


def q_ndcg_at_k(spark, sf):
    return evaluate.mean_over_queries(_lex_pq(spark, sf), ["ndcg_at_10"]).select(_r("ndcg_at_10"))


def q_map_score(spark, sf):
    return evaluate.mean_over_queries(_lex_pq(spark, sf), ["ap"]).select(_r("ap", "map"))


def q_evaluate_run(spark, sf):
    corpus, _, qrels = _lexical(spark, sf)
    return _metrics_row(evaluate.evaluate_run(_bm25_run(spark, sf), qrels, corpus, run_in_corpus=True))


def _lexical_runs(spark, sf):
    return {"BM25": _bm25_run(spark, sf), "TF-IDF-1gr": _tfidf_run(spark, sf, (1, 1)),
            "TF-IDF-2gr": _tfidf_run(spark, sf, (1, 2))}


def q_model_summary(spark, sf):
    corpus, _, qrels = _lexical(spark, sf)
    s = evaluate.model_summary(_lexical_runs(spark, sf), qrels, corpus, run_in_corpus=True)
    return s.select("method", *[_r(c) for c in evaluate.metric_names()], "n_queries")


def _gap(spark, sf):
    corpus, _, qrels = _lexical(spark, sf)
    return evaluate.model_gap_by_query(_bm25_run(spark, sf), _tfidf_run(spark, sf, (1, 2)),
                                       qrels, corpus, "rr", run_in_corpus=True)


def q_model_gap_by_query(spark, sf):
    return _gap(spark, sf).select("query_id", _r("metric_a"), _r("metric_b"), _r("gap"))


# ------------------------------------------------------------------- pairs

def q_pair_word_edit_distance(spark, sf):
    return pairs.pair_word_edit_distance(tasks.text_pairs(spark, sf)).select(
        "query_id", "doc_id", "edit_distance")


def q_pair_common_ngrams(spark, sf):
    return pairs.pair_common_ngrams(tasks.text_pairs(spark, sf), 2).select(
        "query_id", "doc_id", "common_2grams")


def q_pair_lcs(spark, sf):
    return pairs.pair_lcs(tasks.text_pairs(spark, sf)).select("query_id", "doc_id", "lcs")


def q_overlap_by_outcome(spark, sf):
    feats = pairs.pair_features(tasks.text_pairs(spark, sf))
    o = pairs.overlap_by_outcome(_gap(spark, sf), feats)
    return o.select("outcome", "n_pairs", _r("avg_edit_distance"), _r("avg_common_ngrams"),
                    _r("avg_lcs"))


# ----------------------------------------------------------- training data

def _train_edges(spark, sf):
    return split.train_edges(tasks.citations(spark, sf), tasks.paragraphs(spark, sf))


def q_positive_pairs(spark, sf):
    p = training.positive_pairs(_train_edges(spark, sf), tasks.paragraphs(spark, sf))
    return p.select("query_id", "doc_id", "dup", _md5("query_text").alias("query_text_md5"),
                    _md5("positive_text").alias("positive_text_md5"))


def q_training_batches(spark, sf):
    cp = tasks.conversation_pairs(spark, sf)
    b = training.training_batches(cp, ["conv_id", "turn"], seed=42)
    return b.select("conv_id", "turn", "batch_id", "slot")


def q_nested_train_subsets(spark, sf):
    _, _, task = _temporal(spark, sf)
    return training.nested_train_subsets(task["train_queries"])


# --------------------------------------------------------------- pipelines

def q_prepare_retrieval_task(spark, sf):
    """Every table of the task, row by row: (part, id, other, text_md5)."""
    task = split.prepare_retrieval_task(tasks.paragraphs(spark, sf), tasks.citations(spark, sf),
                                        validate=True)
    none = F.lit(None).cast("string")

    def rows(part, other=none, text=None, key="query_id"):
        return task[part].select(F.lit(part).alias("part"), F.col(key).alias("id"),
                                 other.alias("other"), (_md5(text) if text else none).alias("text_md5"))

    out = rows("corpus", text="text", key="doc_id")
    for part in (rows("queries", text="query_text"), rows("val_queries", text="query_text"),
                 rows("qrels", F.col("doc_id").cast("string")),
                 rows("train_queries", _ids("relevant_docs"), "query_text")):
        out = out.unionByName(part)
    return out


def q_prepare_split_jsonl(spark, sf):
    """Every row of the four files: (file, id, n_relevant, text_md5)."""
    from ..operators.splitfiles import write_split_jsonl
    out = write_split_jsonl(tasks.split_edges(spark, sf), tasks.paragraphs(spark, sf),
                            scratch_path(spark, "split_jsonl"))
    u = files.read_jsonl(spark, out["corpus"], files.CORPUS_JSONL_SCHEMA).select(
        F.lit("corpus").alias("file"), F.col("doc_id").alias("id"),
        F.lit(0).cast("long").alias("n_relevant"), _md5("text").alias("text_md5"))
    for n in files.SPLIT_NAMES:
        u = u.unionByName(files.read_jsonl(spark, out[n], files.QUERY_JSONL_SCHEMA).select(
            F.lit(n).alias("file"), F.col("query_id").alias("id"),
            F.size("relevant_docs").cast("long").alias("n_relevant"),
            _md5("query_text").alias("text_md5")))
    return u


def _task(spark, sf):
    """The temporal task, its parts written once: every model below indexes
    the same corpus and is judged by the same judgements."""
    task = split.prepare_retrieval_task(tasks.paragraphs(spark, sf), tasks.citations(spark, sf),
                                        validate=True)
    return [materialize(task[p], f"task_{p}") for p in ("corpus", "queries", "qrels")]


def _task_lexical(corpus, queries):
    runs = {"BM25": lexical.bm25_scores(lexical.bm25_index(corpus), queries)}
    for n in (1, 2):
        runs[f"TF-IDF-{n}gr"] = lexical.tfidf_scores(lexical.tfidf_index(corpus, ngram=(1, n)), queries)
    return runs


def _task_dense(corpus, queries, qrels):
    cv = materialize(dense.encode_texts(corpus, "text", "doc_id"), "corpus_vectors")
    qv = materialize(dense.encode_texts(queries, "query_text", "query_id"), "query_vectors")
    return dense.relevant_ranks(qv, cv, qrels).withColumn("model", F.lit("HashEnc-64"))


def q_lexical_benchmark(spark, sf):
    corpus, queries, qrels = _task(spark, sf)
    s = evaluate.model_summary(_task_lexical(corpus, queries), qrels, corpus, run_in_corpus=True)
    return _through_csv(spark, s, "lexical_summary_csv")


def q_dense_benchmark(spark, sf):
    s = evaluate.summarize(_task_dense(*_task(spark, sf)), ["HashEnc-64"])
    return _through_csv(spark, s, "dense_summary_csv")


def q_combined_benchmark(spark, sf):
    corpus, queries, qrels = _task(spark, sf)
    runs = _task_lexical(corpus, queries)
    lex = evaluate.model_summary(runs, qrels, corpus, run_in_corpus=True)
    s = lex.unionByName(evaluate.summarize(_task_dense(corpus, queries, qrels), ["HashEnc-64"]))
    return _through_csv(spark, s, "combined_summary_csv")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_paragraphs": q_read_paragraphs,
    "read_citations": q_read_citations,
    "read_split_edges": q_read_split_edges,
    "write_jsonl": q_write_jsonl,
    "read_jsonl": q_read_jsonl,
    "write_summary_csv": q_write_summary_csv,
    "paragraph_year": q_paragraph_year,
    "temporal_split": q_temporal_split,
    "text_as_string": q_text_as_string,
    "tokenize": q_tokenize,
    "drop_unresolved_edges": q_drop_unresolved_edges,
    "remove_stop_words": q_remove_stop_words,
    "word_ngrams": q_word_ngrams,
    "score_pair_filter": q_score_pair_filter,
    "edge_source_year": q_edge_source_year,
    "edge_text_lookup": q_edge_text_lookup,
    "queries_from_edges": q_queries_from_edges,
    "drop_within_test_queries": q_drop_within_test_queries,
    "qrels_to_corpus": q_qrels_to_corpus,
    "queries_with_qrels": q_queries_with_qrels,
    "term_match_join": q_term_match_join,
    "query_doc_cross": q_query_doc_cross,
    "citations_by_source": q_citations_by_source,
    "queries_by_split": q_queries_by_split,
    "paragraphs_on_edges": q_paragraphs_on_edges,
    "train_queries": q_train_queries,
    "split_counts": q_split_counts,
    "corpus_stats": q_corpus_stats,
    "top_k_vocabulary": q_top_k_vocabulary,
    "mean_over_queries": q_mean_over_queries,
    "candidate_corpus": q_candidate_corpus,
    "dense_doc_index": q_dense_doc_index,
    "set_overlap": q_set_overlap,
    "top_k_per_query": q_top_k_per_query,
    "full_ranking": q_full_ranking,
    "batch_retrieve": q_batch_retrieve,
    "scores_for_all": q_scores_for_all,
    "bm25_index": q_bm25_index,
    "bm25_top_k": q_bm25_top_k,
    "bm25_saved_index": q_bm25_saved_index,
    "tfidf_top_k_1gr": q_tfidf_top_k_1gr,
    "tfidf_top_k_2gr": q_tfidf_top_k_2gr,
    "cosine_top_k": q_cosine_top_k,
    "cosine_top_k_block": q_cosine_top_k_block,
    "cosine_top_k_lsh": q_cosine_top_k_lsh,
    "cosine_index_quality": q_cosine_index_quality,
    "encode_texts": q_encode_texts,
    "qrel_ranks": q_qrel_ranks,
    "recall_at_k": q_recall_at_k,
    "mrr": q_mrr,
    "ndcg_at_k": q_ndcg_at_k,
    "map_score": q_map_score,
    "evaluate_run": q_evaluate_run,
    "model_summary": q_model_summary,
    "model_gap_by_query": q_model_gap_by_query,
    "pair_word_edit_distance": q_pair_word_edit_distance,
    "pair_common_ngrams": q_pair_common_ngrams,
    "pair_lcs": q_pair_lcs,
    "overlap_by_outcome": q_overlap_by_outcome,
    "positive_pairs": q_positive_pairs,
    "training_batches": q_training_batches,
    "nested_train_subsets": q_nested_train_subsets,
    "prepare_retrieval_task": q_prepare_retrieval_task,
    "prepare_split_jsonl": q_prepare_split_jsonl,
    "lexical_benchmark": q_lexical_benchmark,
    "dense_benchmark": q_dense_benchmark,
    "combined_benchmark": q_combined_benchmark,
}
