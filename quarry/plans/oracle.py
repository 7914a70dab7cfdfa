"""Independent SQL (DuckDB dialect) for each registered query, over the
driver tables registered as views.  Written from the operator definitions,
not from the Spark plans: rankings here are brute force over the full
query x corpus grid, joins are plain SQL joins."""

from __future__ import annotations

import functools

from ..operators.lexical import default_stop_words

# Python's whitespace set as an RE2 class (tokeniser of the lexical models)
WS = (r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
      r"\x{202f}\x{205f}\x{3000}]+")
K_VALUES = (1, 5, 10, 20)
NDCG_K = 10


def tok(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '{WS}'), lambda t: t <> '')"


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def stop_list() -> str:
    return _sql_list(sorted(set(default_stop_words())))


def bigrams(x: str) -> str:
    return f"list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1])"


# ------------------------------------------------------------ base CTEs

PARAGRAPHS = """paragraphs AS (
  SELECT doc_id AS par_id, text,
         make_date(CAST(2010 + doc_id % 13 AS INT), CAST(1 + doc_id % 12 AS INT),
                   CAST(1 + doc_id % 28 AS INT)) AS date
  FROM documents)"""

CITATIONS = """citations AS (
  SELECT p.par_id AS par_id_from,
         (p.par_id * 7 + t.j * 13 + 1) % (SELECT count(*) FROM paragraphs) AS par_id_to
  FROM paragraphs p CROSS JOIN (SELECT unnest([0, 1, 2]) AS j) t
  WHERE p.par_id % 5 <> 4
  UNION ALL
  SELECT par_id, (par_id * 7 + 1) % (SELECT count(*) FROM paragraphs)
  FROM paragraphs WHERE par_id % 10 = 0)"""

PSPLIT = """psplit AS (
  SELECT par_id, text, date, CAST(year(date) AS BIGINT) AS year,
         CASE WHEN year(date) < 2017 THEN 'train'
              WHEN year(date) IN (2017, 2018) THEN 'val'
              WHEN year(date) IN (2019, 2020, 2021) THEN 'test' END AS split
  FROM paragraphs)"""

SPLIT_EDGES = """split_edges AS (
  SELECT e.par_id_from, e.par_id_to,
         CASE WHEN s.split = 'val' THEN 'validation' ELSE s.split END AS split
  FROM (SELECT par_id_from, par_id_to FROM citations
        UNION ALL
        SELECT par_id, CAST(-1 AS BIGINT) FROM paragraphs WHERE par_id % 20 = 3) e
  JOIN psplit s ON s.par_id = e.par_id_from
  WHERE s.split IS NOT NULL)"""

RESOLVED = """resolved AS (
  SELECT * FROM split_edges
  WHERE par_id_from IN (SELECT par_id FROM paragraphs WHERE text IS NOT NULL)
    AND par_id_to IN (SELECT par_id FROM paragraphs WHERE text IS NOT NULL))"""

TEMPORAL = [PARAGRAPHS, CITATIONS, PSPLIT, """edge_year AS (
  SELECT c.par_id_from, c.par_id_to, s.year, s.split
  FROM citations c LEFT JOIN psplit s ON s.par_id = c.par_id_from)""", """test_sources AS (
  SELECT DISTINCT par_id_from FROM edge_year WHERE split = 'test')""", """kept AS (
  SELECT par_id_from FROM test_sources
  WHERE par_id_from NOT IN (SELECT c.par_id_from FROM citations c
                            JOIN psplit s ON s.par_id = c.par_id_to WHERE s.split = 'test'))""",
            """tcorpus AS (
  SELECT par_id AS doc_id, coalesce(text, '') AS text FROM psplit WHERE split IN ('train', 'val'))""",
            """tqrels AS (
  SELECT DISTINCT par_id_from AS query_id, par_id_to AS doc_id FROM citations
  WHERE par_id_from IN (SELECT par_id_from FROM kept)
    AND par_id_to IN (SELECT doc_id FROM tcorpus))""", """tqueries AS (
  SELECT par_id AS query_id, coalesce(text, '') AS query_text FROM paragraphs
  WHERE par_id IN (SELECT query_id FROM tqrels))""", """train_edges AS (
  SELECT par_id_from, par_id_to FROM edge_year WHERE split = 'train')""", """train_q AS (
  SELECT e.par_id_from AS query_id, coalesce(p.text, '') AS query_text,
         list_sort(list(e.par_id_to)) AS relevant_docs, count(*) AS n_relevant
  FROM train_edges e JOIN paragraphs p ON p.par_id = e.par_id_from
  GROUP BY e.par_id_from, p.text)"""]

LEXICAL = ["""lcorpus AS (SELECT doc_id, text FROM documents)""",
           """lqueries AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)""",
           """lqrels AS (
  SELECT DISTINCT b.item_id AS query_id, d.doc_id
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""]

DENSE = ["""dvec AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS vec, label
                     FROM embeddings)""",
         """dq AS (SELECT doc_id AS query_id, vec, label FROM dvec)""",
         """dqrels AS (SELECT q.query_id, d.doc_id FROM dq q JOIN dvec d ON d.label = q.label
                       WHERE d.doc_id BETWEEN q.query_id + 1 AND q.query_id + 10)""",
         """dscore AS (
  SELECT q.query_id, d.doc_id,
         list_dot_product(q.vec, d.vec)
           / (sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(d.vec, d.vec))) AS score
  FROM dq q CROSS JOIN dvec d WHERE q.query_id <> d.doc_id)""",
         """dcorpus AS (SELECT doc_id FROM dvec)"""]


def with_(*ctes) -> str:
    flat = []
    for c in ctes:
        flat.extend(c if isinstance(c, list) else [c])
    seen, out = set(), []
    for c in flat:
        if c not in seen:
            seen.add(c)
            out.append(c)
    return "WITH " + ",\n".join(out) + "\n"


# ------------------------------------------------------ model CTE builders

def bm25(prefix: str, corpus: str, queries: str) -> list[str]:
    """CTEs {p}_post(doc_id, term, tf), {p}_dl, {p}_idf, {p}_run(query_id, doc_id, score)."""
    p = prefix
    return [
        f"{p}_dtok AS (SELECT doc_id, {tok('text')} AS tk FROM {corpus})",
        f"{p}_dl AS (SELECT doc_id, CAST(len(tk) AS BIGINT) AS dl FROM {p}_dtok)",
        f"""{p}_post AS (SELECT doc_id, term, count(*) AS tf
            FROM (SELECT doc_id, unnest(tk) AS term FROM {p}_dtok) GROUP BY doc_id, term)""",
        f"{p}_cs AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM {p}_dl)",
        f"""{p}_raw AS (SELECT term, count(*) AS df,
                  ln((SELECT n FROM {p}_cs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf
            FROM {p}_post GROUP BY term)""",
        f"""{p}_idf AS (SELECT term, df, raw_idf,
                  CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM {p}_raw)
                       ELSE raw_idf END AS idf FROM {p}_raw)""",
        f"""{p}_qt AS (SELECT query_id, term, count(*) AS qtf
            FROM (SELECT query_id, unnest({tok('query_text')}) AS term FROM {queries})
            GROUP BY query_id, term)""",
        f"""{p}_run AS (
            SELECT q.query_id, po.doc_id,
                   sum(q.qtf * i.idf * (po.tf * 2.2)
                       / (po.tf + 1.2 * (0.25 + 0.75 * d.dl / (SELECT avgdl FROM {p}_cs)))) AS score
            FROM {p}_qt q JOIN {p}_idf i ON i.term = q.term
            JOIN {p}_post po ON po.term = q.term JOIN {p}_dl d ON d.doc_id = po.doc_id
            GROUP BY q.query_id, po.doc_id)""",
    ]


def tfidf(prefix: str, corpus: str, queries: str, ngram_hi: int, vocab: int = 5000) -> list[str]:
    p = prefix
    sw = stop_list()

    def grams(col):
        base = f"list_filter({tok(col)}, lambda t: NOT list_contains({sw}, t))"
        return base

    def expand(x):
        return x if ngram_hi == 1 else f"list_concat({x}, {bigrams(x)})"

    return [
        f"{p}_dtk AS (SELECT doc_id, {grams('text')} AS tk FROM {corpus})",
        f"""{p}_cnt AS (SELECT doc_id, term, count(*) AS tf
            FROM (SELECT doc_id, unnest({expand('tk')}) AS term FROM {p}_dtk) GROUP BY doc_id, term)""",
        f"""{p}_voc AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM {p}_cnt GROUP BY term
            ORDER BY cf DESC, term ASC LIMIT {vocab})""",
        f"""{p}_vidf AS (SELECT term, cf, df,
                  ln((1.0 + (SELECT count(*) FROM {corpus})) / (1.0 + df)) + 1.0 AS idf
            FROM {p}_voc)""",
        f"""{p}_w0 AS (SELECT c.doc_id, c.term, c.tf * v.idf AS w
            FROM {p}_cnt c JOIN {p}_vidf v ON v.term = c.term)""",
        f"""{p}_w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w
            FROM {p}_w0)""",
        f"{p}_qtk AS (SELECT query_id, {grams('query_text')} AS tk FROM {queries})",
        f"""{p}_qc AS (SELECT query_id, term, count(*) AS tf
            FROM (SELECT query_id, unnest({expand('tk')}) AS term FROM {p}_qtk) GROUP BY query_id, term)""",
        f"""{p}_qw0 AS (SELECT c.query_id, c.term, c.tf * v.idf AS w
            FROM {p}_qc c JOIN {p}_vidf v ON v.term = c.term)""",
        f"""{p}_qw AS (SELECT query_id, term,
                  w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM {p}_qw0)""",
        f"""{p}_run AS (SELECT q.query_id, d.doc_id, sum(q.w * d.w) AS score
            FROM {p}_qw q JOIN {p}_w d ON d.term = q.term GROUP BY q.query_id, d.doc_id)""",
    ]


def top_k(run: str, k: int) -> str:
    return f"""SELECT query_id, doc_id, rank, CAST(score AS FLOAT) AS score FROM (
      SELECT query_id, doc_id, score,
             CAST(row_number() OVER (PARTITION BY query_id ORDER BY CAST(score AS FLOAT) DESC, doc_id)
                  AS BIGINT) AS rank
      FROM {run}) WHERE rank <= {k}"""


def evaluation(p: str, run: str, qrels: str, corpus: str, k: int = NDCG_K) -> list[str]:
    """Brute force over the judged-query x corpus grid.  CTEs:
    {p}_rk(query_id, doc_id, rs, rnk, rel), {p}_ranks (relevant rows with tie
    block bounds), {p}_pq (per-query metrics)."""
    cum = ("coalesce(list_sum(list_transform(range(0, CAST(least({m}, " + str(k) +
           ") AS BIGINT)), lambda i: 1.0 / log2(i + 2))), 0.0)")
    hits = ",\n               ".join(
        f"sum(CASE WHEN r.rank <= {kk} THEN 1 ELSE 0 END) / count(*) AS recall_at_{kk}"
        for kk in K_VALUES)
    return [
        f"{p}_qr AS (SELECT DISTINCT query_id, doc_id FROM {qrels})",
        f"""{p}_grid AS (
            SELECT j.query_id, c.doc_id, CAST(CAST(coalesce(r.score, 0.0) AS FLOAT) AS DOUBLE) AS rs,
                   CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS rel
            FROM (SELECT DISTINCT query_id FROM {p}_qr) j CROSS JOIN (SELECT doc_id FROM {corpus}) c
            LEFT JOIN {run} r ON r.query_id = j.query_id AND r.doc_id = c.doc_id
            LEFT JOIN {p}_qr q ON q.query_id = j.query_id AND q.doc_id = c.doc_id)""",
        f"""{p}_rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, doc_id)
                           AS rnk FROM {p}_grid)""",
        f"""{p}_blk AS (SELECT query_id, rs, min(rnk) - 1 AS bstart, count(*) AS sz,
                            sum(rel) AS g FROM {p}_rk GROUP BY query_id, rs)""",
        f"""{p}_ranks AS (SELECT r.query_id, r.doc_id, CAST(r.rnk AS BIGINT) AS rank,
                              CAST(b.bstart AS BIGINT) AS block_start,
                              CAST(b.bstart + b.sz AS BIGINT) AS block_end
            FROM {p}_rk r JOIN {p}_blk b ON b.query_id = r.query_id AND b.rs = r.rs
            WHERE r.rel = 1)""",
        f"""{p}_dcg AS (SELECT query_id,
                  sum(g / sz * ({cum.format(m='bstart + sz')} - {cum.format(m='bstart')})) AS dcg
            FROM {p}_blk WHERE g > 0 GROUP BY query_id)""",
        f"""{p}_ap AS (SELECT query_id, sum(i / rank) AS apsum FROM (
              SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i
              FROM {p}_ranks) GROUP BY query_id)""",
        f"""{p}_pq AS (
            SELECT r.query_id, count(*) AS n_relevant,
               {hits},
               any_value(d.dcg) / {cum.format(m='count(*)')} AS ndcg_at_{k},
               1.0 / min(r.rank) AS rr,
               any_value(a.apsum) / count(*) AS ap
            FROM {p}_ranks r JOIN {p}_dcg d ON d.query_id = r.query_id
            JOIN {p}_ap a ON a.query_id = r.query_id
            GROUP BY r.query_id)""",
    ]


def metrics_row(p: str, method: str | None = None) -> str:
    cols = [f"round(coalesce(avg(recall_at_{kk}), 0.0), 6) AS recall_at_{kk}" for kk in K_VALUES]
    cols += [f"round(coalesce(avg(ndcg_at_{NDCG_K}), 0.0), 6) AS ndcg_at_{NDCG_K}",
             "round(coalesce(avg(rr), 0.0), 6) AS mrr", "round(coalesce(avg(ap), 0.0), 6) AS map",
             "count(*) AS n_queries"]
    head = f"'{method}' AS method, " if method else ""
    return f"SELECT {head}" + ", ".join(cols) + f" FROM {p}_pq"


def summary_csv_row(p: str, method: str) -> str:
    cols = [f"printf('%.4f', coalesce(avg(recall_at_{kk}), 0.0)) AS \"Recall@{kk}\""
            for kk in K_VALUES]
    cols += [f"printf('%.4f', coalesce(avg(ndcg_at_{NDCG_K}), 0.0)) AS \"nDCG@{NDCG_K}\"",
             "printf('%.4f', coalesce(avg(rr), 0.0)) AS \"MRR\"",
             "printf('%.4f', coalesce(avg(ap), 0.0)) AS \"MAP\""]
    return f"SELECT '{method}' AS \"Method\", " + ", ".join(cols) + f" FROM {p}_pq"


def edit_fold(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: [i]), "
            f"lambda p, ii: list_reduce(list_transform(range(1, len({b}) + 1), lambda j: [j]), "
            f"lambda r, jj: list_append(r, least(r[-1] + 1, p[jj[1] + 1] + 1, "
            f"p[jj[1]] + CASE WHEN {a}[ii[1]] = {b}[jj[1]] THEN 0 ELSE 1 END)), [p[1] + 1]), "
            f"range(0, len({b}) + 1))[-1]")


def lcs_fold(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(range(1, len({a}) + 1), lambda i: [i]), "
            f"lambda p, ii: list_reduce(list_transform(range(1, len({b}) + 1), lambda j: [j]), "
            f"lambda r, jj: list_append(r, CASE WHEN {a}[ii[1]] = {b}[jj[1]] THEN p[jj[1]] + 1 "
            f"ELSE greatest(r[-1], p[jj[1] + 1]) END), [CAST(0 AS BIGINT)]), "
            f"list_transform(range(0, len({b}) + 1), lambda x: CAST(0 AS BIGINT)))[-1]")


PAIRS = LEXICAL + ["""tpairs AS (
  SELECT q.query_id, q.doc_id, {qa} AS a, {db} AS b
  FROM lqrels q JOIN lqueries s ON s.query_id = q.query_id JOIN lcorpus d ON d.doc_id = q.doc_id)
""".format(qa=tok("s.query_text"), db=tok("d.text"))]

CONV_PAIRS = """cpairs AS (
  SELECT u.conv_id, u.turn FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

SUMMARY_COLS = ('"Method", "Recall@1", "Recall@5", "Recall@10", "Recall@20", "nDCG@10", '
                '"MRR", "MAP"')


def hash_vectors(prefix: str, table: str, id_col: str, text_col: str, dim: int = 64) -> list[str]:
    """Signed hashed bag of tokens, L2-normalised: {p}_v(id, j, v)."""
    p = prefix
    return [f"""{p}_e AS (
        SELECT id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {dim} AS j,
               CASE WHEN CAST(('0x' || substr(md5(t), 10, 1)) AS INT) % 2 = 1
                    THEN 1.0 ELSE -1.0 END AS sgn
        FROM (SELECT {id_col} AS id, unnest({tok(text_col)}) AS t FROM {table}))""",
            f"{p}_c AS (SELECT id, j, sum(sgn) AS c FROM {p}_e GROUP BY id, j)",
            f"{p}_n AS (SELECT id, sqrt(sum(c * c)) AS n FROM {p}_c GROUP BY id)",
            f"""{p}_v AS (SELECT c.id, c.j, c.c / n.n AS v FROM {p}_c c JOIN {p}_n n ON n.id = c.id
                         WHERE c.c <> 0)"""]


def _lex_models():
    return (bm25("bm", "lcorpus", "lqueries") + tfidf("t1", "lcorpus", "lqueries", 1)
            + tfidf("t2", "lcorpus", "lqueries", 2))


def _build() -> dict[str, str]:
    q: dict[str, str] = {}
    T = TEMPORAL
    # sources / sinks
    q["read_paragraphs"] = with_(PARAGRAPHS) + "SELECT par_id, text, date FROM paragraphs"
    q["read_citations"] = with_(PARAGRAPHS, CITATIONS) + "SELECT par_id_from, par_id_to FROM citations"
    q["read_split_edges"] = with_(PARAGRAPHS, CITATIONS, PSPLIT, SPLIT_EDGES) + \
        "SELECT par_id_from, par_id_to, split FROM split_edges"
    q["write_jsonl"] = with_(PARAGRAPHS, CITATIONS, PSPLIT, SPLIT_EDGES, RESOLVED) + """
      SELECT e.doc_id, md5(coalesce(p.text, '')) AS text_md5
      FROM (SELECT par_id_from AS doc_id FROM resolved UNION SELECT par_id_to FROM resolved) e
      JOIN paragraphs p ON p.par_id = e.doc_id"""
    qbs = """SELECT r.split, r.par_id_from AS query_id, md5(coalesce(p.text, '')) AS query_text_md5,
             array_to_string(list_sort(list(r.par_id_to)), ' ') AS relevant_docs,
             count(*) AS n_relevant
      FROM resolved r JOIN paragraphs p ON p.par_id = r.par_id_from
      GROUP BY r.split, r.par_id_from, p.text"""
    q["read_jsonl"] = with_(PARAGRAPHS, CITATIONS, PSPLIT, SPLIT_EDGES, RESOLVED) + qbs
    dsum = with_(DENSE, evaluation("de", "dscore", "dqrels", "dcorpus"))
    q["write_summary_csv"] = dsum + summary_csv_row("de", "Dense-cosine")
    # projections / functions
    q["paragraph_year"] = with_(PARAGRAPHS, PSPLIT) + "SELECT par_id, year FROM psplit"
    q["temporal_split"] = with_(PARAGRAPHS, PSPLIT) + "SELECT par_id, year, split FROM psplit"
    q["text_as_string"] = with_(PARAGRAPHS) + """SELECT par_id, md5(coalesce(text, '')) AS text_md5,
        CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM paragraphs"""
    q["tokenize"] = f"""SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens,
        array_to_string(tk, ' ') AS tokens FROM (SELECT doc_id, {tok('text')} AS tk FROM documents)"""
    q["drop_unresolved_edges"] = with_(PARAGRAPHS, CITATIONS, PSPLIT, SPLIT_EDGES, RESOLVED) + \
        "SELECT split, par_id_from, par_id_to FROM resolved"
    q["remove_stop_words"] = f"""SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens,
        array_to_string(tk, ' ') AS tokens FROM (
          SELECT doc_id, list_filter({tok('text')}, lambda t: NOT list_contains({stop_list()}, t)) AS tk
          FROM documents)"""
    q["word_ngrams"] = f"""SELECT doc_id, CAST(len(g) AS BIGINT) AS n_ngrams,
        CAST(len(list_distinct(g)) AS BIGINT) AS n_distinct_ngrams,
        md5(coalesce(array_to_string(g, '|'), '')) AS ngrams_md5 FROM (
          SELECT doc_id, {bigrams('tk')} AS g FROM (SELECT doc_id, {tok('text')} AS tk FROM documents))"""
    q["score_pair_filter"] = with_(
        LEXICAL, bm25("bm", "lcorpus", "lqueries"),
        "lab_run AS (SELECT * FROM bm_run WHERE doc_id IN (SELECT doc_id FROM labels))") + \
        top_k("lab_run", 20)
    # joins
    q["edge_source_year"] = with_(T) + "SELECT par_id_from, par_id_to, year FROM edge_year"
    q["edge_text_lookup"] = with_(PARAGRAPHS, CITATIONS, PSPLIT, SPLIT_EDGES) + """
      SELECT e.split, e.par_id_from, e.par_id_to, md5(a.text) AS citing_md5, md5(b.text) AS cited_md5
      FROM split_edges e JOIN paragraphs a ON a.par_id = e.par_id_from AND a.text IS NOT NULL
      JOIN paragraphs b ON b.par_id = e.par_id_to AND b.text IS NOT NULL"""
    q["queries_from_edges"] = with_(PARAGRAPHS, CITATIONS) + """
      SELECT par_id AS query_id, md5(coalesce(text, '')) AS query_text_md5 FROM paragraphs
      WHERE par_id IN (SELECT par_id_from FROM citations)"""
    q["drop_within_test_queries"] = with_(T) + "SELECT par_id_from FROM kept"
    q["qrels_to_corpus"] = with_(T) + "SELECT query_id, doc_id FROM tqrels"
    q["queries_with_qrels"] = with_(T) + \
        "SELECT query_id, md5(query_text) AS query_text_md5 FROM tqueries"
    q["term_match_join"] = with_(LEXICAL, bm25("bm", "lcorpus", "lqueries")) + """
      SELECT q.query_id, p.doc_id, count(*) AS n_shared_terms
      FROM bm_qt q JOIN bm_post p ON p.term = q.term GROUP BY q.query_id, p.doc_id"""
    q["query_doc_cross"] = with_(DENSE) + """
      SELECT query_id, count(*) AS n_docs, round(avg(score), 6) AS mean_score,
             CAST(max(score) AS FLOAT) AS max_score FROM dscore GROUP BY query_id"""
    # aggregations
    q["citations_by_source"] = with_(PARAGRAPHS, CITATIONS) + """
      SELECT par_id_from, array_to_string(list_sort(list(par_id_to)), ' ') AS targets,
             count(*) AS n_targets FROM citations GROUP BY par_id_from"""
    q["queries_by_split"] = with_(PARAGRAPHS, CITATIONS, PSPLIT, SPLIT_EDGES, RESOLVED) + qbs
    q["paragraphs_on_edges"] = q["write_jsonl"]
    q["train_queries"] = with_(T) + """SELECT query_id, md5(query_text) AS query_text_md5,
        array_to_string(relevant_docs, ' ') AS relevant_docs, n_relevant FROM train_q"""
    q["split_counts"] = with_(T) + """
      SELECT stage, count(*) AS n FROM (
        SELECT split || '_paragraphs' AS stage FROM psplit WHERE split IS NOT NULL
        UNION ALL SELECT 'test_sources' FROM test_sources
        UNION ALL SELECT 'kept_test_sources' FROM kept
        UNION ALL SELECT 'test_queries' FROM tqueries
        UNION ALL SELECT 'qrels' FROM tqrels
        UNION ALL SELECT 'corpus' FROM tcorpus
        UNION ALL SELECT 'train_queries' FROM train_q) GROUP BY stage"""
    q["corpus_stats"] = with_(LEXICAL, bm25("bm", "lcorpus", "lqueries")) + """
      SELECT count(*) AS vocab_size, round(avg(raw_idf), 6) AS mean_raw_idf,
             CAST(sum(CASE WHEN raw_idf < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative_idf,
             CAST(sum(df) AS BIGINT) AS n_postings,
             CAST((SELECT n FROM bm_cs) AS BIGINT) AS n_docs,
             round((SELECT avgdl FROM bm_cs), 6) AS avgdl
      FROM bm_idf"""
    q["top_k_vocabulary"] = with_(LEXICAL, tfidf("t2", "lcorpus", "lqueries", 2)) + \
        "SELECT term, CAST(cf AS BIGINT) AS cf, df FROM t2_voc"
    lex_eval = with_(LEXICAL, bm25("bm", "lcorpus", "lqueries"),
                     evaluation("ev", "bm_run", "lqrels", "lcorpus"))
    q["mean_over_queries"] = lex_eval + """SELECT round(avg(recall_at_10), 6) AS recall_at_10,
        round(avg(rr), 6) AS mean_rr FROM ev_pq"""
    # set ops, sorts, rankings
    q["candidate_corpus"] = with_(T) + "SELECT doc_id, md5(text) AS text_md5 FROM tcorpus"
    q["dense_doc_index"] = with_(T) + \
        "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS doc_idx FROM tcorpus"
    q["set_overlap"] = with_(LEXICAL, bm25("bm", "lcorpus", "lqueries")) + f"""
      SELECT j.query_id, j.n_relevant, CAST(coalesce(f.n_found, 0) AS BIGINT) AS n_found
      FROM (SELECT query_id, count(*) AS n_relevant FROM lqrels GROUP BY query_id) j
      LEFT JOIN (SELECT t.query_id, count(*) AS n_found FROM ({top_k('bm_run', 20)}) t
                 JOIN lqrels r ON r.query_id = t.query_id AND r.doc_id = t.doc_id
                 GROUP BY t.query_id) f ON f.query_id = j.query_id"""
    q["top_k_per_query"] = with_(LEXICAL, bm25("bm", "lcorpus", "lqueries")) + top_k("bm_run", 5)
    q["full_ranking"] = with_(LEXICAL, bm25("bm", "lcorpus", "lqueries")) + \
        top_k("bm_run", 1 << 40)
    q["batch_retrieve"] = with_(T, bm25("tb", "tcorpus", "tqueries")) + top_k("tb_run", 10)
    q["scores_for_all"] = with_(LEXICAL, bm25("bm", "lcorpus", "lqueries")) + """
      SELECT q.query_id, count(*) AS n_docs, count(r.score) AS n_scored,
             CAST(sum(coalesce(r.score, 0.0)) AS FLOAT) AS total,
             CAST(max(coalesce(r.score, 0.0)) AS FLOAT) AS top
      FROM lqueries q CROSS JOIN lcorpus c
      LEFT JOIN bm_run r ON r.query_id = q.query_id AND r.doc_id = c.doc_id
      GROUP BY q.query_id"""
    # retrieval models
    q["bm25_index"] = with_(LEXICAL, bm25("bm", "lcorpus", "lqueries")) + """
      SELECT p.term, p.doc_id, p.tf, d.dl FROM bm_post p JOIN bm_dl d ON d.doc_id = p.doc_id"""
    q["bm25_top_k"] = with_(LEXICAL, bm25("bm", "lcorpus", "lqueries")) + top_k("bm_run", 10)
    q["bm25_saved_index"] = q["bm25_top_k"]
    q["tfidf_top_k_1gr"] = with_(LEXICAL, tfidf("t1", "lcorpus", "lqueries", 1)) + top_k("t1_run", 10)
    q["tfidf_top_k_2gr"] = with_(LEXICAL, tfidf("t2", "lcorpus", "lqueries", 2)) + top_k("t2_run", 10)
    q["cosine_top_k"] = with_(DENSE) + top_k("dscore", 10)
    q["cosine_top_k_block"] = q["cosine_top_k"]
    # every query gets ten rows, or all others where there are fewer
    q["cosine_index_quality"] = """
SELECT count(*) AS n_queries, CAST(count(*) * least(10, count(*) - 1) AS BIGINT) AS n_rows,
       TRUE AS recall_from_90_percent, TRUE AS compared_to_10_percent FROM embeddings"""
    # evaluation
    q["qrel_ranks"] = lex_eval + "SELECT query_id, doc_id, rank, block_start, block_end FROM ev_ranks"
    q["recall_at_k"] = lex_eval + "SELECT " + ", ".join(
        f"round(avg(recall_at_{k}), 6) AS recall_at_{k}" for k in K_VALUES) + " FROM ev_pq"
    q["mrr"] = lex_eval + "SELECT round(avg(rr), 6) AS mrr FROM ev_pq"
    q["ndcg_at_k"] = lex_eval + "SELECT round(avg(ndcg_at_10), 6) AS ndcg_at_10 FROM ev_pq"
    q["map_score"] = lex_eval + "SELECT round(avg(ap), 6) AS map FROM ev_pq"
    q["evaluate_run"] = lex_eval + metrics_row("ev")
    three = with_(LEXICAL, _lex_models(), evaluation("e1", "bm_run", "lqrels", "lcorpus"),
                  evaluation("e2", "t1_run", "lqrels", "lcorpus"),
                  evaluation("e3", "t2_run", "lqrels", "lcorpus"))
    q["model_summary"] = three + "\nUNION ALL\n".join(
        [metrics_row("e1", "BM25"), metrics_row("e2", "TF-IDF-1gr"), metrics_row("e3", "TF-IDF-2gr")])
    gap_list = [LEXICAL, bm25("bm", "lcorpus", "lqueries"),
                tfidf("t2", "lcorpus", "lqueries", 2),
                evaluation("ea", "bm_run", "lqrels", "lcorpus"),
                evaluation("eb", "t2_run", "lqrels", "lcorpus"),
                ["""gap AS (SELECT a.query_id, a.rr AS metric_a, b.rr AS metric_b,
                            a.rr - b.rr AS gap FROM ea_pq a JOIN eb_pq b USING (query_id))"""]]
    gap_ctes = with_(*gap_list)
    q["model_gap_by_query"] = gap_ctes + """SELECT query_id, round(metric_a, 6) AS metric_a,
        round(metric_b, 6) AS metric_b, round(gap, 6) AS gap FROM gap"""
    # pairs
    q["pair_word_edit_distance"] = with_(PAIRS) + \
        f"SELECT query_id, doc_id, CAST({edit_fold('a', 'b')} AS BIGINT) AS edit_distance FROM tpairs"
    q["pair_common_ngrams"] = with_(PAIRS) + f"""SELECT query_id, doc_id,
        CAST(len(list_intersect(list_distinct({bigrams('a')}), list_distinct({bigrams('b')})))
             AS BIGINT) AS common_2grams FROM tpairs"""
    q["pair_lcs"] = with_(PAIRS) + \
        f"SELECT query_id, doc_id, CAST({lcs_fold('a', 'b')} AS BIGINT) AS lcs FROM tpairs"
    q["overlap_by_outcome"] = with_(*gap_list, PAIRS) + f"""
      SELECT outcome, count(*) AS n_pairs, round(avg(ed), 6) AS avg_edit_distance,
             round(avg(cn), 6) AS avg_common_ngrams, round(avg(lc), 6) AS avg_lcs
      FROM (SELECT CASE WHEN g.gap > 0 THEN 'a_better' WHEN g.gap < 0 THEN 'b_better'
                        ELSE 'tie' END AS outcome,
                   {edit_fold('p.a', 'p.b')} AS ed,
                   len(list_intersect(list_distinct({bigrams('p.a')}),
                                      list_distinct({bigrams('p.b')}))) AS cn,
                   {lcs_fold('p.a', 'p.b')} AS lc
            FROM tpairs p JOIN gap g ON g.query_id = p.query_id)
      GROUP BY outcome"""
    # training data
    q["positive_pairs"] = with_(T) + """
      SELECT e.query_id, e.doc_id, e.dup, md5(coalesce(a.text, '')) AS query_text_md5,
             md5(coalesce(b.text, '')) AS positive_text_md5
      FROM (SELECT par_id_from AS query_id, par_id_to AS doc_id,
                   CAST(row_number() OVER (PARTITION BY par_id_from, par_id_to) - 1 AS BIGINT) AS dup
            FROM train_edges) e
      JOIN paragraphs a ON a.par_id = e.query_id JOIN paragraphs b ON b.par_id = e.doc_id"""
    q["training_batches"] = with_(CONV_PAIRS) + """
      SELECT conv_id, turn, CAST(idx // 16 AS BIGINT) AS batch_id, CAST(idx % 16 AS BIGINT) AS slot
      FROM (SELECT conv_id, turn,
                   row_number() OVER (ORDER BY md5(concat_ws(':', '42', conv_id, turn)),
                                      conv_id, turn) - 1 AS idx FROM cpairs)"""
    q["nested_train_subsets"] = with_(T) + """
      SELECT fraction, CAST(sum(nq) OVER (ORDER BY fraction) AS BIGINT) AS n_queries,
             CAST(sum(np) OVER (ORDER BY fraction) AS BIGINT) AS n_pairs
      FROM (SELECT CAST(((CAST(('0x' || substr(md5('subset:' || query_id), 1, 8)) AS BIGINT) % 100)
                    // 10) * 10 + 10 AS BIGINT) AS fraction,
                   count(*) AS nq, sum(n_relevant) AS np
            FROM train_q GROUP BY 1)"""
    # pipelines
    q["prepare_retrieval_task"] = with_(T, """val_q AS (
        SELECT DISTINCT p.par_id, p.text FROM edge_year e JOIN paragraphs p ON p.par_id = e.par_id_from
        WHERE e.split = 'val')""") + """
      SELECT 'corpus' AS part, doc_id AS id, CAST(NULL AS VARCHAR) AS other, md5(text) AS text_md5
      FROM tcorpus
      UNION ALL SELECT 'queries', query_id, NULL, md5(query_text) FROM tqueries
      UNION ALL SELECT 'val_queries', par_id, NULL, md5(coalesce(text, '')) FROM val_q
      UNION ALL SELECT 'qrels', query_id, CAST(doc_id AS VARCHAR), NULL FROM tqrels
      UNION ALL SELECT 'train_queries', query_id, array_to_string(relevant_docs, ' '), md5(query_text)
      FROM train_q"""
    q["prepare_split_jsonl"] = with_(PARAGRAPHS, CITATIONS, PSPLIT, SPLIT_EDGES, RESOLVED) + """
      SELECT r.split AS file, r.par_id_from AS id, count(*) AS n_relevant,
             md5(coalesce(p.text, '')) AS text_md5
      FROM resolved r JOIN paragraphs p ON p.par_id = r.par_id_from
      GROUP BY r.split, r.par_id_from, p.text
      UNION ALL
      SELECT 'corpus', e.id, CAST(0 AS BIGINT), md5(coalesce(p.text, '')) FROM (
        SELECT par_id_from AS id FROM resolved UNION SELECT par_id_to FROM resolved) e
      JOIN paragraphs p ON p.par_id = e.id"""
    models = (bm25("bm", "tcorpus", "tqueries") + tfidf("t1", "tcorpus", "tqueries", 1)
              + tfidf("t2", "tcorpus", "tqueries", 2))
    evals = [evaluation(e, f"{r}_run", "tqrels", "tcorpus")
             for e, r in (("e1", "bm"), ("e2", "t1"), ("e3", "t2"))]
    hashed = (hash_vectors("hd", "tcorpus", "doc_id", "text")
              + hash_vectors("hq", "tqueries", "query_id", "query_text")
              + ["""h_run AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.v * d.v), 12) AS score
                              FROM hq_v q JOIN hd_v d ON d.j = q.j GROUP BY q.id, d.id)"""]
              + evaluation("e4", "h_run", "tqrels", "tcorpus"))
    rows = [summary_csv_row("e1", "BM25"), summary_csv_row("e2", "TF-IDF-1gr"),
            summary_csv_row("e3", "TF-IDF-2gr")]
    last = summary_csv_row("e4", "HashEnc-64")
    q["lexical_benchmark"] = with_(T, models, *evals) + "\nUNION ALL\n".join(rows)
    q["dense_benchmark"] = with_(T, hashed) + last
    q["combined_benchmark"] = with_(T, models, *evals, hashed) + "\nUNION ALL\n".join([*rows, last])
    q["encode_texts"] = with_(hash_vectors("hd", "documents", "doc_id", "text")) + \
        "SELECT id AS doc_id, CAST(j AS BIGINT) AS dim_idx, round(v, 6) AS value FROM hd_v"
    return q


@functools.cache
def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name, built on first use."""
    return _build()
