"""Line dedup across documents.

1. Explode: each document's lines become (doc_id, 128-bit hash of the line's
   key), one row per distinct key of the document; texts stay behind.
2. Count: a key's smallest and largest doc_id, summed up on the map side.  The
   two differ exactly when the key lies in at least two documents, so a line
   that a third of all documents share costs one row per task.
3. Drop: rows of repeated keys outside the smallest document; the join's hot
   keys are split at run time, as both sides are plain shuffles.
4. Reassemble: the keys a document loses are gathered by document (no more
   than its lines) and joined to its text, which loses those lines in place.

A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends, A-Z
lower-cased; keys shorter than ``min_chars`` code points always stay.

Defined results: a null or empty text is one empty line; rows with the same
doc_id count as one document; null doc_ids are one document after all others;
a repeated line in the smallest document stays there every time; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .textscan import LOWER, SPACE, Texts, range_hash, slices

MIN_CHARS = 10
MIN_DOCS = 2
LAST = (1 << 63) - 1  # stands for a null doc_id


def _line_keys(t: Texts, min_chars: int):
    """For each line of a slice: (start, end, first, h1, h2, long enough)."""
    start, end, first = t.lines()
    lowered = t.raw.translate(LOWER)
    n = len(t.buf)
    solid = np.frombuffer(t.raw.translate(SPACE), dtype=np.uint8) == 0
    at = np.flatnonzero(solid)
    # the first and the last solid byte of each line
    a = np.searchsorted(at, start)
    z = np.searchsorted(at, end)
    any_ = z > a
    ks = np.where(any_, at[np.minimum(a, max(len(at) - 1, 0))], start) if len(at) else start
    ke = np.where(any_, at[np.maximum(z - 1, 0)] + 1, ks) if len(at) else start
    # code points: bytes that don't continue a UTF-8 sequence
    heads = np.zeros(n + 1, dtype=np.int64)
    np.cumsum((t.buf & 0xC0) != 0x80, out=heads[1:])
    long_ = heads[ke] - heads[ks] >= min_chars
    pick = np.flatnonzero(long_)
    h1 = np.zeros(len(start), dtype=np.uint64)
    h2 = np.zeros(len(start), dtype=np.uint64)
    h1[pick] = range_hash(lowered, ks[pick], ke[pick], seed=1)
    h2[pick] = range_hash(lowered, ks[pick], ke[pick], seed=2)
    return start, end, first, h1, h2, long_


def document_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, h1, h2): the distinct keys of each row's lines."""
    def explode(batches):
        for b in slices(batches):
            t = Texts(b.column("text"))
            _, _, first, h1, h2, long_ = _line_keys(t, min_chars)
            owner = np.repeat(np.arange(t.n), np.diff(first))[long_]
            h1, h2 = h1[long_], h2[long_]
            order = np.lexsort((h2, h1, owner))
            o, a, z = owner[order], h1[order], h2[order]
            new = np.ones(len(o), dtype=bool)
            new[1:] = (o[1:] != o[:-1]) | (a[1:] != a[:-1]) | (z[1:] != z[:-1])
            d = b.column("d").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[o[new]]), pa.array(a[new].view(np.int64)),
                 pa.array(z[new].view(np.int64))], ["d", "h1", "h2"])

    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "text") \
        .mapInArrow(explode, "d long, h1 long, h2 long")


def lines_to_drop(lines: DataFrame) -> DataFrame:
    """(d, drop): per document the keys it loses, as packed 16-byte entries."""
    keys = materialize(lines.groupBy("h1", "h2").agg(F.min("d").alias("a"), F.max("d").alias("z"))
                       .filter(F.col("a") < F.col("z")).select("h1", "h2", "a"), "repeated_lines")
    lost = lines.join(keys, ["h1", "h2"]).filter(F.col("d") != F.col("a"))
    return lost.groupBy("d").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, keep_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (and the kept text)."""
    lines = materialize(document_lines(docs, min_chars), "line_keys")
    drop = lines_to_drop(lines)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("d"), "text")
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" \
        + (", text string" if keep_text else "")

    def reassemble(batches):
        for b in slices(batches):
            t = Texts(b.column("text"))
            start, end, first, h1, h2, long_ = _line_keys(t, min_chars)
            dropped = np.zeros(len(start), dtype=bool)
            lists = b.column("drop")
            flat = lists.flatten()
            if len(flat):
                sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0,
                                 np.nan_to_num(lists.value_lengths().to_numpy(
                                     zero_copy_only=False))).astype(np.int64)
                who = np.repeat(np.arange(t.n), sizes)
                a = flat.field("h1").to_numpy(zero_copy_only=False).view(np.uint64)
                z = flat.field("h2").to_numpy(zero_copy_only=False).view(np.uint64)
                gone = np.zeros(len(who), dtype=[("d", "i8"), ("a", "u8"), ("z", "u8")])
                gone["d"], gone["a"], gone["z"] = who, a, z
                line = np.zeros(len(start), dtype=gone.dtype)
                line["d"] = np.repeat(np.arange(t.n), np.diff(first))
                line["a"], line["z"] = h1, h2
                dropped = _member(line, gone) & long_
            hit = np.flatnonzero(dropped)
            n_dropped = np.diff(np.searchsorted(hit, first))
            kept = []
            for i in range(t.n):
                if not n_dropped[i]:
                    kept.append(t.text(i))
                    continue
                js = [j for j in range(first[i], first[i + 1]) if not dropped[j]]
                kept.append(b"\n".join(t.raw[start[j]:end[j]] for j in js))
            cols = [b.column("doc_id"), pa.array(np.diff(first)), pa.array(n_dropped),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if keep_text:
                cols.append(pa.array(kept, type=pa.binary()).cast(pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.join(drop, "d", "left").select("doc_id", "text", "drop") \
        .mapInArrow(reassemble, schema)


def _member(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which records of ``rows`` are in ``of`` (records d, a, z)."""
    both = np.concatenate((of, rows))
    order = np.lexsort((both["z"], both["a"], both["d"]))
    s = both[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    run = np.cumsum(new) - 1
    has = np.zeros(run[-1] + 1 if len(run) else 0, dtype=bool)
    has[run[order < len(of)]] = True
    out = np.empty(len(both), dtype=bool)
    out[order] = has[run]
    return out[len(of):]
