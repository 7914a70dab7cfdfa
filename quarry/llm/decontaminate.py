"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all 16-word passages.
2. A randomised SVD of the TF-IDF passage matrix A, fitted on all passages:
   tasks of about ``FIT_PASSAGES`` each add up their part of B = A'(A O) for a
   seeded Gaussian O, parts are summed by blocks of terms, and a Nystrom step
   on B (terms x rank, fixed size) gives right singular vectors and values.
3. Candidates: 16-word windows of every text, 8 words apart, and of every
   benchmark item are projected (scaled by inverse singular values) and
   compared by cosine, inside the task that read the text.  Candidates whose
   place in the text holds too few words of the item for any alignment to pass
   the checks aren't aligned; no match is lost by that.  Items shorter than a
   window are also looked up by words: of their rarest words, so many that an
   accepted alignment can't do without all of them, every occurrence in a text
   is a candidate.
4. Checks on the words themselves: the longest common subsequence of an item
   and the place in the text must cover ``VERBATIM`` of the item, or
   ``PARAPHRASE`` of it with its answer there as well.  An item's answer is
   its ``answer`` column, or else its last words.

Only term statistics and the parts of B cross the network.  The benchmark is the
query set: its items reach the driver and the tasks in blocks of about
``ITEM_BYTES`` or ``BLOCK_ITEMS``, each searched for in all texts.  All texts
are compared in full, however long.

Defined results: a null or empty text matches nothing; items with fewer than
``MIN_ITEM_WORDS`` words, or null, are ignored; repeated items and repeated
rows each get their own matches; without items or documents the result is
empty; words are compared A-Z lower-cased; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import Texts, range_hash, slices

TERMS = 1 << 14
RANK = 64
OVERSAMPLE = 8
WINDOW = 16
STRIDE = 8
COSINE = 0.5
VERBATIM = 0.8
PARAPHRASE = 0.65
ANSWER_WORDS = 5
ANSWER_SHARE = 0.8
MIN_ITEM_WORDS = 5
BLOCK_ITEMS = 2048         # terms of a block's items: 32 MB in a task
ITEM_BYTES = 4 << 20
FIT_PASSAGES = 1 << 18     # of a task of the fit, which sends a whole part of B
FIT_TASKS = 8              # of the fit at least
TERM_BLOCK = 256
SLICE = 1 << 19
LONGEST = 1 << 24      # words that an item may begin before a slice
ITEM_COLUMNS = 128     # items whose words are counted side by side
CELLS = 1 << 21        # words that are compared with their items at once
SEED = 7


def _hashes(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    ws, we, first = t.words()
    return range_hash(t.raw, ws, we), first


def _terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) % TERMS


def _cuts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of consecutive passages of ``size`` words."""
    n = -(-np.diff(first) // size)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return first[:-1][text] + at * size, text


def _rows(terms: np.ndarray, at: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` terms from each word ``at``; TERMS beyond ``end``."""
    place = at[:, None] + np.arange(size)
    out = terms.astype(np.int32)[np.minimum(place, len(terms) - 1)]
    out[place >= end[:, None]] = TERMS
    return out


def passage_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(passages that hold each term, passages)."""
    def count(batches):
        df, n = np.zeros(TERMS, dtype=np.int64), 0
        for b in slices(batches, max_bytes=4 * SLICE):
            h, first = _hashes(Texts(b.column("text"), lower=True))
            if not len(h):
                continue
            at, text = _cuts(first, WINDOW)
            held = np.sort(_rows(_terms(h), at, first[text + 1], WINDOW), axis=1)
            new = held < TERMS                      # each term of a passage once
            new[:, 1:] &= held[:, 1:] != held[:, :-1]
            df += np.bincount(held[new], minlength=TERMS)
            n += len(at)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(term, -1)), pa.array(np.append(df[term], n))], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long") \
        .groupBy("term").agg(F.sum("n").alias("n")).collect()     # at most TERMS + 1 rows
    df = np.zeros(TERMS, dtype=np.int64)
    n = 0
    for r in rows:
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, n


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(1e-3)


def _gaussian() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((TERMS, RANK + OVERSAMPLE)).astype(np.float32)


def fit_sample(docs: DataFrame, n: int) -> DataFrame:
    """All texts, read in tasks of about ``FIT_PASSAGES`` of their ``n`` passages."""
    # each task sends a whole part of B: few of them, however many partitions there are
    return docs.select("text").coalesce(max(FIT_TASKS, -(-n // FIT_PASSAGES)))


def _group_sums(rows: np.ndarray, index: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Sums of the rows ``index`` of each group, which begin at ``head``.  Groups
    are cut into pieces of ``WINDOW`` rows; all pieces' j-th rows are added at once."""
    size = np.diff(np.append(head, len(index)))
    n = -(-size // WINDOW)
    first = np.cumsum(n) - n
    at = (np.arange(int(n.sum())) - np.repeat(first, n)) * WINDOW
    length = np.minimum(np.repeat(size, n) - at, WINDOW)
    order = np.argsort(-length, kind="stable")
    begin = (np.repeat(head, n) + at)[order]
    longer = len(order) - np.cumsum(np.bincount(length, minlength=WINDOW + 1))
    total = rows.take(index[begin], axis=0)
    for j in range(1, WINDOW):
        total[:longer[j]] += rows.take(index[begin[:longer[j]] + j], axis=0)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return np.add.reduceat(total.take(back, axis=0), first, axis=0)


def sketch_product(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """B = A'(A O): terms x (rank + oversample), summed over all passages."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    wide = RANK + OVERSAMPLE

    def part(batches):
        w = np.append(shared.value, np.float32(0))             # the last one of no term
        table = np.concatenate((_gaussian(), np.zeros((1, wide), dtype=np.float32))) * w[:, None]
        total = np.zeros((TERMS, wide))
        for b in slices(batches, max_bytes=4 * SLICE):
            h, first = _hashes(Texts(b.column("text"), lower=True))
            at, _ = _cuts(first, WINDOW)
            end = np.append(at[1:], len(h))
            for lo in range(0, len(at), SLICE // WINDOW):      # of a very long text
                here = slice(lo, lo + SLICE // WINDOW)
                first_word, size = at[lo], end[here] - at[here]
                term = _terms(h[first_word:end[here][-1]])
                held = np.ascontiguousarray(_rows(term, at[here] - first_word, end[here] - first_word, WINDOW).T)
                y = table.take(held[0], axis=0)
                for j in range(1, WINDOW):
                    y += table.take(held[j], axis=0)
                y /= np.maximum((w[held] ** 2).sum(axis=0), 1e-12)[:, None]      # unit rows, twice
                passage = np.repeat(np.arange(len(size)), size)
                order = np.argsort(term.astype(np.uint16), kind="stable")
                s = term[order]
                head = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                total[s[head]] += _group_sums(y, passage[order], head) * w[s[head]][:, None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(0, TERMS, TERM_BLOCK)),
             pa.array([total[i:i + TERM_BLOCK].tobytes() for i in range(0, TERMS, TERM_BLOCK)])],
            ["block", "part"])

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, x in zip(b.column("block").to_pylist(), b.column("part")):
                v = np.frombuffer(x.as_buffer(), dtype=np.float64)
                if block in sums:
                    sums[block] += v
                else:
                    sums[block] = v.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), type=pa.int64()), pa.array([v.tobytes() for v in sums.values()],
                                                             type=pa.binary())], ["block", "part"])

    schema = "block long, part binary"
    rows = docs.select("text").mapInArrow(part, schema).repartition(F.col("block")) \
        .mapInArrow(added, schema).collect()                # TERMS x rank numbers
    out = np.zeros((TERMS, wide))
    for r in rows:
        out[r["block"]:r["block"] + TERM_BLOCK] += np.frombuffer(r["part"]).reshape(-1, wide)
    shared.unpersist()
    return out


def singular_vectors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors, singular values) of A from B = A'A O."""
    o = _gaussian().astype(np.float64)
    shift = np.sqrt(TERMS) * 1e-9 * max(np.linalg.norm(b), 1e-30)
    b = b + shift * o
    core = o.T @ b
    val, vec = np.linalg.eigh((core + core.T) / 2)
    keep = val > val.max() * 1e-10
    f = b @ (vec[:, keep] / np.sqrt(val[keep]))
    u, s, _ = np.linalg.svd(f, full_matrices=False)
    return u[:, :RANK], np.sqrt(np.maximum(s[:RANK] ** 2 - shift, 1e-12))


def latent_table(docs: DataFrame) -> np.ndarray:
    """Per term its weight in the latent space: idf x vector / value."""
    return latent_terms(docs)[0]


def latent_terms(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(latent_table, passages that hold each term)."""
    df, n = passage_frequencies(docs)
    idf = idf_of(df, n)
    u, s = singular_vectors(sketch_product(fit_sample(docs, n), idf))
    return (idf[:, None] * u / np.maximum(s, s.max() * 1e-3)).astype(np.float32), df


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def windows(table: np.ndarray, h: np.ndarray, first: np.ndarray):
    """(unit vectors, first word, text) of the 16-word windows at every 8th
    word; a text's last window may be shorter."""
    at, text = _cuts(first, STRIDE)
    wide = np.concatenate((table, np.zeros((1, table.shape[1]), dtype=table.dtype)))
    held = _rows(_terms(h), at, first[text + 1], STRIDE)
    half = wide[held[:, 0]]
    for j in range(1, STRIDE):
        half += wide[held[:, j]]
    full = half.copy()
    follows = np.flatnonzero(text[1:] == text[:-1])
    full[follows] += half[follows + 1]
    lone = np.zeros(len(at), dtype=bool)      # the tail half is inside the window before
    lone[1:] = (text[1:] == text[:-1])
    lone[:-1] &= text[1:] != text[:-1]
    keep = ~lone
    return _unit(full[keep]), at[keep], text[keep]


def lcs(words: dict[int, int], size: int, other: list[int]) -> int:
    """Longest common subsequence; words: bit mask of places by word."""
    full = (1 << size) - 1
    v = full
    for m in [words[y] for y in other if y in words]:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _masks(h: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(h):
        out[x] = out.get(x, 0) | (1 << i)
    return out


class Items:
    """The benchmark as queries."""

    def __init__(self, ids: list, texts: list, answers: list, table: np.ndarray,
                 df: np.ndarray | None = None):
        t = Texts(pa.array(texts, type=pa.string()), lower=True)
        h, first = _hashes(t)
        a = Texts(pa.array(answers, type=pa.string()), lower=True)
        ah, afirst = _hashes(a)
        self.ids, self.words, self.masks, self.answers = ids, [], [], []
        vec, item, at, rare = [], [], [], []
        for i in range(len(ids)):
            w = h[first[i]:first[i + 1]]
            own = ah[afirst[i]:afirst[i + 1]]
            own = own if len(own) else w[-ANSWER_WORDS:]
            self.words.append(w.tolist())
            self.masks.append(_masks(w.tolist()))
            self.answers.append((_masks(own.tolist()), len(own)))
            n = len(w)
            if n < MIN_ITEM_WORDS:
                continue
            if n < WINDOW:
                seldom = np.argsort(df[_terms(w)] if df is not None else np.zeros(n), kind="stable")
                rare += [(w[j], i, j) for j in seldom[:n - int(np.ceil(PARAPHRASE * n)) + 1].tolist()]
            for o in sorted({*range(0, max(n - WINDOW, 0) + 1, STRIDE), max(n - WINDOW, 0)}):
                vec.append(table[_terms(w[o:o + WINDOW])].sum(axis=0))
                item.append(i)
                at.append(o)
        self.item, self.at = np.array(item, dtype=np.int64), np.array(at, dtype=np.int64)
        rare.sort()
        self.rare, self.rare_first = np.unique(
            np.array([r[0] for r in rare], dtype=np.uint64), return_index=True)
        self.rare_first = np.append(self.rare_first, len(rare))
        self.rare_item = np.array([r[1] for r in rare], dtype=np.int64)
        self.rare_at = np.array([r[2] for r in rare], dtype=np.int64)
        self.has = np.zeros((len(ids), TERMS), dtype=bool)      # terms of each item
        for i in range(len(ids)):
            self.has[i, _terms(h[first[i]:first[i + 1]])] = True
        self.columns = [np.ascontiguousarray(self.has[lo:lo + ITEM_COLUMNS].T.astype(np.int8))
                        for lo in range(0, len(ids), ITEM_COLUMNS)]
        self.size = np.diff(first)
        self.vectors = _unit(np.array(vec, dtype=np.float32)) if vec else None

    def lookup(self, h: np.ndarray):
        """Blocks of (word of the text, short item, its place in the text) for
        the rare words of short items."""
        if not len(self.rare):
            return
        x = np.minimum(np.searchsorted(self.rare, h), len(self.rare) - 1)
        pos = np.flatnonzero(self.rare[x] == h)
        head = self.rare_first[x[pos]]
        n = self.rare_first[x[pos] + 1] - head
        end = np.cumsum(n)
        lo = 0
        while lo < len(pos):
            hi = max(int(np.searchsorted(end, end[lo] - n[lo] + CELLS // 16, side="right")), lo + 1)
            part = n[lo:hi]
            e = np.arange(int(part.sum())) + np.repeat(head[lo:hi] - (np.cumsum(part) - part), part)
            at = np.repeat(pos[lo:hi], part)
            yield at, self.rare_item[e], at - self.rare_at[e]
            lo = hi

    def around(self, i, lo, hi, place):
        """(first, last + 1) of the words around a place that item i is aligned with."""
        slack = np.maximum(STRIDE + 4, self.size[i] // 4)
        return np.maximum(lo, place - slack), np.minimum(hi, place + self.size[i] + slack)

    def possible(self, i, a, b, terms: np.ndarray) -> np.ndarray:
        """Whether enough of the words a..b-1 are words of item i: their number
        bounds the longest common subsequence from above."""
        size = np.maximum(b - a, 0)
        count = np.zeros(len(i), dtype=np.int64)
        # many candidates of a block of items: counts by eighths of a passage,
        # over a few words more on both sides, leave few to be counted exactly
        load = np.bincount(i, weights=size, minlength=len(self.ids))
        some = np.ones(len(i), dtype=bool)
        for lo in range(0, len(self.ids), ITEM_COLUMNS):
            here = load[lo:lo + ITEM_COLUMNS]
            if 8 * here.sum() < len(terms) * len(here):
                continue
            whole = -(-len(terms) // STRIDE)
            held = np.empty((whole * STRIDE, len(here)), dtype=np.int8)
            held[len(terms):] = 0
            np.take(self.columns[lo // ITEM_COLUMNS], terms, axis=0, out=held[:len(terms)], mode="clip")
            total = np.zeros((whole + 1, len(here)), dtype=np.int32)
            held = held.reshape(whole, STRIDE, -1)
            eighth = held[:, 0].copy()
            for j in range(1, STRIDE):
                eighth += held[:, j]
            np.cumsum(eighth, axis=0, out=total[1:])
            on = np.flatnonzero((i >= lo) & (i < lo + ITEM_COLUMNS))
            most = total[-(-np.maximum(a[on], b[on]) // STRIDE), i[on] - lo] - total[a[on] // STRIDE, i[on] - lo]
            some[on] = most >= PARAPHRASE * self.size[i[on]]
        rest = np.flatnonzero(some)
        end = np.cumsum(size[rest])
        x = 0
        while x < len(rest):
            y = max(int(np.searchsorted(end, end[x] - size[rest[x]] + CELLS, side="right")), x + 1)
            on = rest[x:y]
            part = size[on]
            stop = np.cumsum(part)
            at = np.arange(int(stop[-1])) + np.repeat(a[on] - (stop - part), part)
            hit = np.append(0, np.cumsum(self.has[np.repeat(i[on], part), terms[at]]))
            count[on] = hit[stop] - hit[stop - part]
            x = y
        return count >= PARAPHRASE * self.size[i]

    def check(self, i: int, other: list[int]):
        """(lcs, answer found) of item i and words of a text."""
        n = len(self.words[i])
        got = lcs(self.masks[i], n, other)
        if got < PARAPHRASE * n:
            return got, False
        masks, size = self.answers[i]
        return got, lcs(masks, size, other) >= ANSWER_SHARE * size


def align(items: Items, h, terms, first, text, item, place, found: dict) -> None:
    """Check candidates (text, item, place) and put the matches into ``found``."""
    a, b = items.around(item, first[text], first[text + 1], place)
    some = items.possible(item, a, b, terms)
    tried = set()
    for k, i, p, lo, hi in zip(*(x[some].tolist() for x in (text, item, place, a, b))):
        if (k, i, p) in tried:
            continue
        tried.add((k, i, p))
        n = len(items.words[i])
        got, answer = items.check(i, h[lo:hi].tolist())
        if got >= VERBATIM * n or (got >= PARAPHRASE * n and answer):
            if got > found.get((k, i), (0,))[0]:
                found[k, i] = (got, answer, max(p - int(first[k]), 0))


def match(items: Items, table: np.ndarray, h: np.ndarray, first: np.ndarray, cosine: float):
    """{(text, item): (lcs, answer found, first word)} of the contaminated pairs."""
    found: dict[tuple[int, int], tuple] = {}
    if items.vectors is None or not len(h):
        return found
    terms = _terms(h)
    for at, item, place in items.lookup(h):
        align(items, h, terms, first, np.searchsorted(first, at, side="right") - 1, item, place, found)
    vec, at, text = windows(table, h, first)
    for lo in range(0, len(vec), 8192):
        near = np.flatnonzero((vec[lo:lo + 8192] @ items.vectors.T >= cosine).reshape(-1))
        x, c = np.divmod(near, len(items.vectors))
        x += lo
        # the windows of one copy agree about its place
        place = at[x] - items.at[c]
        key = (items.item[c] * (len(h) + LONGEST) + place + LONGEST // 2) * (int(text[-1]) + 1) + text[x]
        _, some = np.unique(key, return_index=True)
        align(items, h, terms, first, text[x[some]], items.item[c[some]], place[some], found)
    return found


def _item_blocks(benchmark: DataFrame):
    """The items as (ids, texts, answers), block by block; a generator, so one
    block is on the driver at a time."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None)
    rows = benchmark.select("item_id", "text", answer.cast("string").alias("answer")) \
        .filter(F.col("text").isNotNull())
    size = F.octet_length("text") + F.coalesce(F.octet_length("answer"), F.lit(0))
    n, total = rows.agg(F.count(F.lit(1)), F.sum(size)).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-(total or 0) // ITEM_BYTES))
    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        if part:
            yield tuple(list(x) for x in zip(*part))


def _searchers(docs: DataFrame, benchmark: DataFrame):
    """For each block of items a function () -> (items, table) for the tasks."""
    terms = None
    for block in _item_blocks(benchmark):
        terms = terms or latent_terms(docs)
        shared = docs.sparkSession.sparkContext.broadcast((*terms, *block))

        def items(shared=shared):
            table, df, ids, texts, answers = shared.value
            return Items(ids, texts, answers, table, df), table

        yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, lcs_words, item_words, answer_found, at_word: one row
    for each document and each benchmark item it contains."""
    schema = "doc_id long, item_id long, lcs_words int, item_words int, answer_found boolean, at_word long"
    out = None
    for load in _searchers(docs, benchmark):
        part = _contaminated(docs, load, cosine, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _contaminated(docs: DataFrame, load, cosine: float, schema: str) -> DataFrame:
    def search(batches):
        items, table = load()
        for b in slices(batches, max_bytes=SLICE):
            h, first = _hashes(Texts(b.column("text"), lower=True))
            hits = sorted(match(items, table, h, first, cosine).items())
            k = [x[0][0] for x in hits]
            i = [x[0][1] for x in hits]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(k, type=pa.int64())),
                 pa.array([items.ids[x] for x in i], type=pa.int64()),
                 pa.array([x[1][0] for x in hits], type=pa.int32()),
                 pa.array([len(items.words[x]) for x in i], type=pa.int32()),
                 pa.array([x[1][1] for x in hits], type=pa.bool_()),
                 pa.array([x[1][2] for x in hits], type=pa.int64())],
                ["doc_id", "item_id", "lcs_words", "item_words", "answer_found", "at_word"])

    return docs.select("doc_id", "text").mapInArrow(search, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item."""
    out = docs
    for load in _searchers(docs, benchmark):
        out = _clean(out, load, cosine)
    return out


def _clean(docs: DataFrame, load, cosine: float) -> DataFrame:
    def search(batches):
        items, table = load()
        for b in slices(batches, max_bytes=SLICE):
            h, first = _hashes(Texts(b.column("text"), lower=True))
            clean = np.ones(b.num_rows, dtype=bool)
            clean[[k for k, _ in match(items, table, h, first, cosine)]] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(search, docs.schema)
