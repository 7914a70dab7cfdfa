"""Suffix-array dedup: repeated byte strings of ``min_len`` across all texts.

A window is a ``min_len``-byte string of one text.  The job decides for every
window whether the same string starts anywhere else (``keep="none"``) or at
an earlier position, by doc_id and offset (``keep="first"``, which removes
later copies only), and removes the bytes that such windows cover.

Sorting all suffixes of a corpus would shuffle each byte hundreds of times,
so the suffix array is sparse.

1. Anchors: every window picks its smallest-hash 64-byte substring; equal
   windows pick the same anchor at the same place.  Neighbouring windows share
   anchors (one per 170 bytes or so), so an anchor stands for a run of windows
   and the region they span.
2. Anchors that occur once in the corpus end here: their windows are unique.
3. Regions that occur twice in full have repeats all over.  Of a region's
   copies only the first goes on, so thousands of equal texts cost one.
4. What is left are different regions around equal anchors.  Within one
   anchor, regions are put in suffix order from the anchor on, and in the
   order of the reversed text before it, with the longest common prefixes of
   neighbours.  Two windows at the same distance from the anchor are equal
   when no smaller common prefix lies between them in either order.  Runs of
   equal windows are listed by text position: the one before in the run is the
   previous smaller position of the longest-previous-factor array, the one
   after its mirror.
5. Anchors with more than ``MAX_BUCKET`` different regions (a passage that a
   third of all documents embed) aren't gathered.  Their regions are cut into
   cells of ``CELL`` windows, keyed by what the windows of a cell share, and
   steps 2 to 4 run on the cells; where even a cell has too many kinds, its
   windows are compared by 128-bit digests in an ordinary aggregation.
6. The runs of removed windows are gathered by text and cut out.

Defined results: a null text is empty; texts shorter than ``min_len`` lose
nothing; a null doc_id sorts last; rows with one doc_id are texts of their
own; a row repeated in full is a copy of the other, and as neither comes first,
``keep="first"`` leaves both as if they were one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .textscan import Texts, mix, slices

MIN_LEN = 400
ANCHOR = 64
TILE = 1 << 20
MAX_BUCKET = 1024
CELL = 12
SALT_ROWS = 4096       # rows of a key from which they are dealt over tasks
HOT_KEYS = 100_000
LAST = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_ROWS = 1500


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Hasher:
    """Hashes of all k-byte substrings of a tile from one running sum."""

    def __init__(self, k: int):
        self.k, self.n = k, 0
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def __call__(self, buf: np.ndarray) -> np.ndarray:
        n = len(buf)
        if n > self.n:
            self.n = max(n, TILE + 4096)
            self.up = _powers(BASE, self.n)
            self.down = _powers(pow(BASE, -1, 1 << 64), self.n)
        s = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.table[buf] * self.up[:n], out=s[1:])
        m = n - self.k + 1
        return mix((s[self.k:] - s[:m]) * self.down[:m])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from block-wise running minima."""
    n = len(v)
    size = -(-n // w) * w
    p = np.full(size, np.iinfo(v.dtype).max, dtype=v.dtype)
    p[:n] = v
    blocks = p.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def tile_anchors(hasher: Hasher, buf: np.ndarray, offs: np.ndarray, lo: int, hi: int, min_len: int):
    """(hash, anchor, first window, last window) for the windows that start in
    lo..hi-1, as positions in ``buf``; texts lie between ``offs``."""
    end = min(len(buf), hi + min_len - 1)
    if end - lo < min_len:
        return None
    h = hasher(buf[lo:end])
    low = np.uint64(0xFFFFFFFF)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)     # leftmost of equals
    best = (sliding_min(v, min_len - hasher.k + 1) & low).astype(np.int64)
    start = np.arange(len(best))
    text = np.searchsorted(offs, lo + start, side="right") - 1
    ok = offs[np.minimum(text + 1, len(offs) - 1)] - (lo + start) >= min_len
    start, best = start[ok], best[ok]
    if not len(start):
        return None
    new = np.ones(len(start), dtype=bool)
    new[1:] = (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    anchor = best[first]
    return h[anchor], lo + anchor, lo + start[first], lo + start[last]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("d"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")


def anchors(keyed: DataFrame, min_len: int, k: int) -> DataFrame:
    """(h, r1, r2, d, th, pos, a, z): each anchor, the 128-bit digest of its
    region, and its first and last window, as offsets in the text."""
    def scan(batches):
        import xxhash
        hasher = Hasher(k)
        for b in slices(batches, max_bytes=TILE):
            t = Texts(b.column("text"))
            view = memoryview(t.raw)
            d, th = (b.column(c).to_numpy() for c in ("d", "th"))
            for lo in range(0, max(len(t.buf), 1), TILE):
                got = tile_anchors(hasher, t.buf, t.offs, lo, min(lo + TILE, len(t.buf)), min_len)
                if got is None:
                    continue
                h, pos, a, z = got
                r = np.frombuffer(b"".join(
                    [xxhash.xxh3_128_digest(view[i:j]) for i, j in
                     zip(a.tolist(), (z + min_len).tolist())]), dtype="<i8").reshape(-1, 2)
                own = np.searchsorted(t.offs, pos, side="right") - 1
                base = t.offs[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h.view(np.int64), r[:, 0], r[:, 1], d[own], th[own],
                                           pos - base, a - base, z - base)],
                    ["h", "r1", "r2", "d", "th", "pos", "a", "z"])

    return keyed.select("d", "th", "text").mapInArrow(
        scan, "h long, r1 long, r2 long, d long, th long, pos long, a long, z long")


def equal_windows(gid, left, right, valid, base):
    """(other, earlier): for region x and distance base[x] + o from the anchor,
    whether another region of the same group, or one before x, has the same
    window.

    left: reversed bytes before the anchors, right: bytes from the anchors on
    (padded), valid[x, o]: x has that window; base is the same in a group.
    Regions are in text order."""
    n, reach = valid.shape
    size = right.shape[1]

    def classes(m):
        key = np.ascontiguousarray(m).view(f"S{m.shape[1]}").ravel()
        order = np.lexsort((key, gid))
        s, g = m[order], gid[order]
        lcp = np.zeros(n, dtype=np.int64)
        if n > 1:
            differs = s[1:] != s[:-1]
            lcp[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), m.shape[1])
            lcp[1:][g[1:] != g[:-1]] = -1
        lcp[0] = -1
        return order, lcp

    lo, llcp = classes(left)
    ro, rlcp = classes(right)
    o = base[:, None] + np.arange(reach)[None]
    cl = np.empty((n, reach), dtype=np.int64)
    cr = np.empty((n, reach), dtype=np.int64)
    cl[lo] = np.cumsum(llcp[:, None] < o[lo], axis=0)
    cr[ro] = np.cumsum(rlcp[:, None] < size - o[ro], axis=0)
    key = np.where(valid, cl * (n + 1) + cr, -1 - np.arange(n)[:, None])
    order = np.argsort(key, axis=0, kind="stable")
    run = np.take_along_axis(key, order, axis=0)
    same = run[1:] == run[:-1]
    prev = np.zeros((n, reach), dtype=bool)
    near = np.zeros((n, reach), dtype=bool)
    prev[1:] = same
    near[:-1] = same
    earlier = np.empty_like(prev)
    other = np.empty_like(prev)
    np.put_along_axis(earlier, order, prev, axis=0)
    np.put_along_axis(other, order, prev | near, axis=0)
    return other, earlier


def _runs(mask: np.ndarray):
    """(row, first, last) of each run of True in the rows."""
    edge = np.zeros((mask.shape[0], mask.shape[1] + 2), dtype=np.int8)
    edge[:, 1:-1] = mask
    step = np.diff(edge, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, first, last - 1


def _resolve(contexts: DataFrame, min_len: int, k: int, first_stays: bool,
             cell: int | None = None) -> DataFrame:
    """(d, th, lo, hi): byte runs to remove, from the regions of each anchor
    or, with ``cell``, of each cell."""
    reach = min_len - k + 1

    def chunk(rows):
        # in text order; a row repeated in full is one text here, but a region
        # cut by a tile's border is two rows of one anchor
        rows = [r for _, r in sorted({(r[1], r[2], r[3], r[0], r[4], r[5]): r for r in rows}.items())]
        h = np.array([r[0] for r in rows])
        n, width = len(rows), cell or reach
        left = np.zeros((n, reach), dtype=np.uint8)
        right = np.zeros((n, min_len), dtype=np.uint8)
        valid = np.zeros((n, width), dtype=bool)
        base = np.zeros(n, dtype=np.int64)
        for x, (_, _, _, pos, a, z, ctx) in enumerate(rows):
            c = np.frombuffer(ctx, dtype=np.uint8)
            at = pos - a                       # the anchor's place in the region
            left[x, :at] = c[:at][::-1]
            tail = c[at:at + min_len]
            right[x, :len(tail)] = tail
            base[x] = (pos - z) // cell * cell if cell else 0
            valid[x, pos - z - base[x]:pos - a - base[x] + 1] = True
        other, earlier = equal_windows(np.unique(h, return_inverse=True)[1], left, right, valid, base)
        row, o1, o2 = _runs(earlier if first_stays else other)
        near = np.array([r[3] for r in rows])[row] - base[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array([r[1] for r in rows])[row]), pa.array(np.array([r[2] for r in rows])[row]),
             pa.array(near - o2), pa.array(near - o1 + min_len)], ["d", "th", "lo", "hi"])

    def resolve(batches):
        rows = []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("h", "d", "th", "pos", "a", "z", "ctx"))):
                if len(rows) >= CHUNK_ROWS and rows[-1][0] != r[0]:
                    yield chunk(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield chunk(rows)

    return contexts.select("h", "d", "th", "pos", "a", "z", "ctx").repartition(F.col("h")) \
        .sortWithinPartitions("h").mapInArrow(resolve, "d long, th long, lo long, hi long")


def _cells(contexts: DataFrame, min_len: int) -> DataFrame:
    """Regions cut into cells of ``CELL`` windows by distance from the anchor.
    h: digest of what all windows of a cell have in common, with the cell's
    place, so equal windows meet under one h; (r1, r2): digest of the cell."""
    def cut(batches):
        import xxhash
        for b in batches:
            out = []
            for h, d, th, pos, a, z, ctx in zip(*(b.column(c).to_pylist() for c in (
                    "h", "d", "th", "pos", "a", "z", "ctx"))):
                for i in range((pos - z) // CELL, (pos - a) // CELL + 1):
                    lo, hi = max(a, pos - i * CELL - CELL + 1), min(z, pos - i * CELL)
                    at = pos - i * CELL - a
                    core = ctx[at:at + min_len - CELL + 1]    # in every window of the cell
                    cell = ctx[lo - a:hi - a + min_len]
                    r = xxhash.xxh3_128_digest(cell, seed=pos - lo)
                    out.append((xxhash.xxh3_64_intdigest(core, seed=(h ^ i) & (2 ** 64 - 1)) - 2 ** 63,
                                d, th, pos, lo, hi, cell, int.from_bytes(r[:8], "big", signed=True),
                                int.from_bytes(r[8:], "big", signed=True)))
            names = ["h", "d", "th", "pos", "a", "z", "ctx", "r1", "r2"]
            cols = list(zip(*out)) if out else [()] * 9
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.binary() if x == "ctx" else pa.int64()) for x, c in zip(names, cols)],
                names)

    return contexts.mapInArrow(cut, "h long, d long, th long, pos long, a long, z long, ctx binary, "
                                    "r1 long, r2 long")


def _extract(keyed: DataFrame, wanted: DataFrame, min_len: int) -> DataFrame:
    """(h, d, th, pos, a, z, ctx) for the anchors of ``wanted``."""
    per = wanted.groupBy("d", "th").agg(F.collect_list(F.struct("h", "pos", "a", "z")).alias("at"))

    def cut(batches):
        for b in slices(batches):
            t = Texts(b.column("text"))
            at = b.column("at")
            sizes = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.repeat(np.arange(t.n), sizes)
            flat = at.flatten()
            h, pos, a, z = (flat.field(c).to_numpy() for c in ("h", "pos", "a", "z"))
            base = t.offs[own]
            ctx = [t.raw[i:j] for i, j in zip((base + a).tolist(), (base + z + min_len).tolist())]
            d, th = (b.column(c).to_numpy()[own] for c in ("d", "th"))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x) for x in (h, d, th, pos, a, z)), pa.array(ctx, type=pa.binary())],
                ["h", "d", "th", "pos", "a", "z", "ctx"])

    # a row repeated in full has one text and one list of anchors
    texts = keyed.select("d", "th", "text")
    return texts.join(per, ["d", "th"]).mapInArrow(
        cut, "h long, d long, th long, pos long, a long, z long, ctx binary")


def _by_digest(contexts: DataFrame, min_len: int, first_stays: bool) -> DataFrame:
    """As _resolve, for anchors with too many regions to gather: windows are
    counted by digest, then looked up."""
    def windows(batches):
        import xxhash
        for b in batches:
            for d, th, a, z, ctx in zip(*(b.column(c).to_pylist() for c in ("d", "th", "a", "z", "ctx"))):
                n = z - a + 1
                view = memoryview(ctx)
                w = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[i:i + min_len])
                                            for i in range(n)]), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(np.full(n, d)),
                     pa.array(np.full(n, th)), pa.array(np.arange(a, z + 1))],
                    ["w1", "w2", "d", "th", "s"])

    w = materialize(contexts.mapInArrow(windows, "w1 long, w2 long, d long, th long, s long"),
                    "hot_windows")
    seen = materialize(w.groupBy("w1", "w2").agg(
        F.min(F.struct("d", "th", "s")).alias("first"),
        F.max(F.struct("d", "th", "s")).alias("last")).filter("first != last"), "hot_repeats")
    hit = w.join(seen, ["w1", "w2"])
    if first_stays:
        hit = hit.filter(F.struct("d", "th", "s") != F.col("first"))
    return hit.select("d", "th", F.col("s").alias("lo"), (F.col("s") + min_len).alias("hi"))


def _meet(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined to the one row of ``keyed`` for their keys; ``n`` is its
    number of rows, and is dropped.  Keys of very many rows are dealt over
    several tasks: their rows by place, with a copy of the keyed row for each.
    These keys are at most ``HOT_KEYS`` by choice of the bound, so they can be
    told to all tasks."""
    bound = max(SALT_ROWS, -(-rows.count() // HOT_KEYS))
    salts = F.ceil(F.col(n) / bound).cast("int")
    hot = keyed.filter(F.col(n) > bound).select(*keys, salts.alias("salts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "salt", F.pmod(F.xxhash64("d", "th", "pos"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copies = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(
        F.col(n) > bound, salts - 1).otherwise(0)))).drop(n)
    return dealt.join(copies, [*keys, "salt"]).drop("salt")


def repeated_runs(docs_keyed: DataFrame, min_len: int, keep: str, k: int = ANCHOR,
                  max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(d, th, lo, hi): byte runs to remove; runs of one text may overlap."""
    first_stays = keep == "first"
    found = materialize(anchors(docs_keyed, min_len, k), "suffix_anchors")
    twice = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix_repeated")
    found = materialize(_meet(found, twice, ["h"], "n"), "suffix_candidates")
    # copies of a region: one row each, with the first copy's place
    regions = materialize(found.groupBy("h", "r1", "r2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "th", "pos", "a", "z")).alias("first")),
        "suffix_regions")
    copies = regions.filter("n > 1").select("r1", "r2", "h", "first", "n")
    copied = _meet(found, materialize(copies, "suffix_copies"), ["h", "r1", "r2"], "n")
    if first_stays:
        copied = copied.filter(F.struct("d", "th", "pos", "a", "z") != F.col("first"))
    runs = copied.select("d", "th", F.col("a").alias("lo"), (F.col("z") + min_len).alias("hi"))
    # different regions around one anchor; without order, one that has copies
    # is decided but may be what another one matches
    many = materialize(regions.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"),
                       "suffix_anchors_open")
    todo = materialize(regions.join(many, "h").select("h", "m", "first.*"), "suffix_open")
    ctx = materialize(_extract(docs_keyed, todo.select("d", "th", "h", "pos", "a", "z"), min_len)
                      .join(many.filter(F.col("m") > max_bucket).select("h", F.lit(True).alias("hot")),
                            "h", "left"), "suffix_contexts")
    runs = runs.unionByName(_resolve(ctx.filter("hot IS NULL"), min_len, k, first_stays))
    return runs.unionByName(_hot_runs(ctx.filter("hot"), min_len, k, first_stays, max_bucket))


def _hot_runs(contexts: DataFrame, min_len: int, k: int, first_stays: bool, max_bucket: int):
    """As _resolve, for anchors with too many regions to gather: the same
    steps again for cells of a few windows, which most regions share in full
    or not at all."""
    cells = materialize(_cells(contexts, min_len), "suffix_cells")
    met = cells.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cells = materialize(_meet(cells, materialize(met, "suffix_cells_met"), ["h"], "n"), "suffix_cells_open")
    place = F.struct("d", "th", "pos", "a", "z", "ctx")
    kinds = materialize(cells.groupBy("h", "r1", "r2").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first")), "suffix_cell_kinds")
    copied = _meet(cells, kinds.filter("n > 1").select("h", "r1", "r2", "first", "n"), ["h", "r1", "r2"], "n")
    if first_stays:
        copied = copied.filter(place != F.col("first"))
    runs = copied.select("d", "th", F.col("a").alias("lo"), (F.col("z") + min_len).alias("hi"))
    many = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    todo = materialize(kinds.join(materialize(many, "suffix_cells_many"), "h").select("h", "m", "first.*"),
                       "suffix_cells_todo")
    few, most = todo.filter(F.col("m") <= max_bucket), todo.filter(F.col("m") > max_bucket)
    return runs.unionByName(_resolve(few, min_len, k, first_stays, CELL)) \
        .unionByName(_by_digest(most, min_len, first_stays))


def dedup_substrings(docs: DataFrame, min_len: int = MIN_LEN, keep: str = "first",
                     keep_text: bool = False, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``text``: the kept
    text, where bytes that no longer form a character are dropped)."""
    keyed = _keyed(docs)
    runs = repeated_runs(keyed, min_len, keep, max_bucket=max_bucket)
    per = runs.groupBy("d", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("cut"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" \
        + (", text string" if keep_text else "")

    def finish(batches):
        for b in slices(batches):
            t = Texts(b.column("text"))
            n_removed, n_spans, kept = [], [], []
            cuts = b.column("cut")
            for i in range(t.n):
                text = t.text(i)
                cut = cuts[i].as_py()
                if not cut:
                    n_removed.append(0), n_spans.append(0), kept.append(text)
                    continue
                merged = []
                for lo, hi in sorted((c["lo"], c["hi"]) for c in cut):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                n_removed.append(sum(hi - lo for lo, hi in merged))
                n_spans.append(len(merged))
                at = [0, *(x for m in merged for x in m), len(text)]
                kept.append(b"".join(text[at[j]:at[j + 1]] for j in range(0, len(at), 2)))
            cols = [b.column("doc_id"), pa.array(np.diff(t.offs)), pa.array(n_removed, type=pa.int64()),
                    pa.array(n_spans, type=pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            if keep_text:
                cols.append(pa.array([x.decode("utf-8", "ignore") for x in kept], type=pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in schema.split(", ")])

    return keyed.join(per, ["d", "th"], "left").select("doc_id", "text", "cut").mapInArrow(finish, schema)
