import os
import tempfile

from quarry.operators import lexical
from quarry.operators.ranking import top_k_per_query
from quarry.plans import tasks
from quarry.streaming.retrieve import (load_bm25_index, query_file_stream, save_bm25_index,
                                       stream_bm25_top_k)

from conftest import SF001


def test_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="quarry-stream-")
    corpus = tasks.lexical_corpus(spark, SF001)
    queries = tasks.lexical_queries(spark, SF001)
    save_bm25_index(lexical.bm25_index(corpus), os.path.join(base, "index"))
    inbox = os.path.join(base, "inbox")
    # queries land in two files -> two micro-batches
    queries.filter("query_id % 2 = 0").coalesce(1).write.parquet(os.path.join(inbox, "a"))
    queries.filter("query_id % 2 = 1").coalesce(1).write.parquet(os.path.join(inbox, "b"))
    stream = query_file_stream(spark, os.path.join(inbox, "*"), max_files_per_trigger=1)
    out = os.path.join(base, "out")
    q = stream_bm25_top_k(stream, os.path.join(base, "index"), out, k=5,
                          checkpoint=os.path.join(base, "ckpt"))
    q.awaitTermination(300)
    got = {(r.query_id, r.doc_id, r["rank"]) for r in spark.read.parquet(out).collect()}
    index = load_bm25_index(spark, os.path.join(base, "index"))
    exp = {(r.query_id, r.doc_id, r["rank"])
           for r in top_k_per_query(lexical.bm25_scores(index, queries), 5).collect()}
    assert got == exp and len(got) > 0
