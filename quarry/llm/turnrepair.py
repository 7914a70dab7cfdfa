"""Conversation structure repair: cheapest edits, least audit string.

A conversation's rows are read by turn.  Each row is kept (K, free), given the
role that its place needs (R, 2) or deleted (D, 3; blank and duplicate rows
must be); empty user and assistant turns are inserted anywhere (I, 2); a
truncated row that stays costs 1 more.  The roles that result read
``(s?(ua)+)?``.  Of the cheapest edits the ASCII-least string of K, R, D and I,
the audit, is taken.

1. Thin rows: equal rows of a turn are counted on the map side; texts stay
   behind, their MD5 travels.
2. Duplicates: rows are range-partitioned and sorted by (conversation, role and
   text, turn), so a row repeats an earlier one exactly when its neighbour
   before it has its conversation, role and text; the first row of a task is
   compared with the last row of the task before.
3. Segments: rows are range-partitioned and sorted by (conversation, turn,
   role, MD5); each task cuts them into segments of one conversation and at
   most ``SEGMENT`` rows.  A conversation of any length is spread over tasks.
4. Cost: nodes are (rows done, state of the pattern).  A segment's least costs
   from state to state are a 4 x 4 matrix; from the last segment backwards
   they give the cost from every segment's end, and then from every node.
5. Audit by prefix doubling: arcs that keep the cost are the optimal ones.
   Nodes are ranked by the least audit of 1, 2, 4, ... edits that starts
   there: the rank for 2^(k+1) follows from the pair (own rank for 2^k, rank of
   the node 2^k edits on).  At each node the optimal arc with the least
   (edit, rank of its end) is taken; pointers doubled along these arcs give
   the edit at every position of every path without walking it.  A node never
   has two optimal arcs with the same edit, as its state fixes the role that a
   rerole or insertion gives.
6. A path enters a segment in the state in which it left the one before.
   Repaired rows meet their texts by (conversation, turn, MD5), and the hash
   of a conversation is fed row by row in order.

Memory: a task holds one batch of rows or segments.  An audit is one cell of
the result, and a hash is a sequential function, so a conversation's repaired
rows pass one task each, in a stream.

Defined results: null roles and texts are one space; null turns come first;
a null conv_id is a conversation of its own; rows of one turn are ordered by
role, then by the MD5 of role and text; a role counts by its first character;
``copies`` 0 keeps a conversation without rows: zeros, an empty audit and the
hash of an empty string; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SEGMENT = 4096
PIECE = 1 << 16
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4      # in ASCII order of D, I, K, R
NEVER = 1 << 40
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
NEXT = np.array([2, 2, 3, 2])                  # the state after the role that is due
KEPT = {0: {0: 1, 1: 2}, 1: {1: 2}, 2: {2: 3}, 3: {1: 2}}   # state: {role: state}
LAST = np.array([0, 4, 2, 0])                  # insertions that end a conversation
KEYS = ["cn", "c"]
EMPTY = hashlib.sha256(b"").hexdigest()


def _consume() -> np.ndarray:
    """Cost from state to state over one row, [role, fault, state, state]
    (role 3: neither s, u nor a), without insertions."""
    cost = np.full((4, 4, 4, 4), NEVER, dtype=np.int64)
    for role in range(4):
        for fault in (0, BLANK, DUPLICATE, TRUNCATED):
            m = cost[role, fault]
            m[range(4), range(4)] = 3
            if fault in (BLANK, DUPLICATE):
                continue
            extra = int(fault == TRUNCATED)
            for s in range(4):
                m[s, NEXT[s]] = min(m[s, NEXT[s]], 2 + extra)
                if role in KEPT[s]:
                    t = KEPT[s][role]
                    m[s, t] = min(m[s, t], extra)
    return cost


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least sums of matrices (..., 4, 4)."""
    return (a[..., :, :, None] + b[..., None, :, :]).min(axis=-2)


def _insertions() -> np.ndarray:
    m = np.full((4, 4), NEVER, dtype=np.int64)
    m[range(4), range(4)] = 0
    one = np.full((4, 4), NEVER, dtype=np.int64)
    one[range(4), NEXT] = 2
    return np.minimum(m, np.minimum(one, _times(one, one)))


STEP = _times(_insertions(), _consume())       # one row, with insertions before it
LEGAL = np.zeros((4, 4), dtype=bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True


# ------------------------------------------------------------------- damage

def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by
    crc32(``conv_id:turn``) % 20 -- 0 drops, 1 empties the text, 2 removes its
    sentence ends, 3 repeats, 4 makes the role user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
        .alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("long")
        .alias("copies"))


# ---------------------------------------------------------------- thin rows

def _keyed(rows: DataFrame) -> DataFrame:
    """cn, c, tn, t (0 and 0 for null), role, text, h, copies."""
    space = F.lit(" ")
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long")
    r = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"),
                    F.coalesce("text", space).alias("text"), copies.alias("copies"))

    def nulls(name: str, out: str) -> list[Column]:
        return [F.col(name).isNotNull().cast("int").alias(out + "n"),
                F.coalesce(name, F.lit(0)).cast("long").alias(out)]

    return r.select(*nulls("conv_id", "c"), *nulls("turn", "t"), "role", "text", "copies",
                    F.md5(F.concat("role", F.lit("\0"), "text")).alias("h"))


def _thin(rows: DataFrame) -> DataFrame:
    """One row per (conversation, turn, role, text); a conversation's rows
    without copies are one row with n = 0."""
    k = _keyed(rows)
    there = F.col("copies") > 0
    tail = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(tail == "", BLANK).when(~tail.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    k = k.select(*KEYS, F.when(there, F.col("tn")).otherwise(0).alias("tn"),
                 F.when(there, F.col("t")).otherwise(0).alias("t"),
                 F.when(there, F.col("role")).otherwise("").alias("role"),
                 F.when(there, F.col("h")).otherwise("0" * 32).alias("h"),
                 F.when(there, role).otherwise(3).alias("kind"),
                 F.when(there, fault).otherwise(0).alias("fault"), F.greatest("copies", F.lit(0)).alias("copies"))
    return k.groupBy(*KEYS, "tn", "t", "role", "h", "kind", "fault").agg(F.sum("copies").alias("n"))


def _hex(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.cast(pa.binary()).to_pylist()), dtype="S32")


def _columns(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(x).to_numpy(zero_copy_only=False) for x in names]


def _with_duplicates(thin: DataFrame) -> DataFrame:
    """Sets ``fault`` to DUPLICATE on rows whose role and text an earlier turn has."""
    def flag(batches):
        pid, at, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            cn, c = _columns(b, *KEYS)
            h = _hex(b.column("h"))
            same = np.zeros(len(c), dtype=bool)
            same[1:] = (cn[1:] == cn[:-1]) & (c[1:] == c[:-1]) & (h[1:] == h[:-1])
            if last is not None:
                same[0] = last == (cn[0], c[0], h[0])
            last = cn[-1], c[-1], h[-1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(same), pa.array(np.full(len(c), pid, dtype=np.int32)),
                 pa.array(np.arange(at, at + len(c)))], [*b.schema.names, "again", "pid", "at"])
            at += len(c)

    order = [*KEYS, "h", "tn", "t"]
    schema = ", ".join(f"{n} {k}" for n, k in thin.dtypes)
    done = materialize(thin.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        flag, f"{schema}, again boolean, pid int, at long"), "turn_duplicates")
    key = F.struct(*KEYS, "h")
    # one row per task: its first and its last key
    ends = done.groupBy("pid").agg(F.min_by(key, "at").alias("first"), F.max_by(key, "at").alias("last"))
    border = ends.select("pid", F.lit(0).cast("long").alias("at"),
                         (F.col("first") == F.lag("last").over(Window.orderBy("pid"))).alias("joined"))
    again = F.col("again") | F.coalesce("joined", F.lit(False))
    return done.join(border, ["pid", "at"], "left").withColumn(
        "fault", F.when(again & (F.col("fault") != BLANK) & (F.col("n") > 0), DUPLICATE)
        .otherwise(F.col("fault"))).select(*thin.columns)


# ----------------------------------------------------------------- segments

SEGMENTS = ("cn int, c long, pid int, seg long, tn array<int>, t array<long>, h array<string>, "
            "kind array<int>, fault array<int>, m array<long>, blank long, duplicate long, "
            "truncated long, illegal long, first int, last int, low long, high long, turns long")


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))


def _local(first: np.ndarray) -> np.ndarray:
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


def _matrices(kind: np.ndarray, fault: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Least costs from state to state over all rows of each segment."""
    size = np.diff(first)
    out = np.full((len(size), 4, 4), NEVER, dtype=np.int64)
    out[:, range(4), range(4)] = 0
    for i in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > i)
        at = first[on] + i
        out[on] = _times(out[on], STEP[kind[at], fault[at]])
    return np.minimum(out, NEVER)


def _segment_batch(pid, seg, cn, c, tn, t, h, kind, fault, ghost):
    """Segments of consecutive rows; a row marked ghost only names its conversation."""
    new = np.ones(len(c), dtype=bool)
    new[1:] = (cn[1:] != cn[:-1]) | (c[1:] != c[:-1])
    run = np.flatnonzero(new)
    new |= (np.arange(len(c)) - np.repeat(run, np.diff(np.append(run, len(c))))) % SEGMENT == 0
    heads = np.flatnonzero(new)
    owner = np.cumsum(new) - 1
    cn, c = cn[heads], c[heads]
    real = ~ghost
    owner, tn, t, h, kind, fault = (x[real] for x in (owner, tn, t, h, kind, fault))
    n = len(heads)
    first = np.searchsorted(owner, np.arange(n + 1))
    inside = np.zeros(len(t), dtype=bool)
    inside[1:] = owner[1:] == owner[:-1]
    bad, turn = inside.copy(), tn == 1
    bad[1:] &= ~LEGAL[kind[:-1], kind[1:]]
    fresh = turn.copy()
    fresh[1:] &= ~(inside[1:] & turn[:-1] & (t[1:] == t[:-1]))

    def total(what):
        return pa.array(np.bincount(owner[what], minlength=n).astype(np.int64))

    def edge(values, some, last):
        """The first or last of ``values[some]`` in each segment, or null."""
        own, v = owner[some], values[some]
        lo, hi = np.searchsorted(own, np.arange(n)), np.searchsorted(own, np.arange(n), side="right")
        none = lo == hi
        at = np.where(none, 0, hi - 1 if last else lo)
        return pa.array(v[at] if len(v) else np.zeros(n, dtype=v.dtype), mask=none)

    every = np.ones(len(t), dtype=bool)
    m = _matrices(kind, fault, first)
    return pa.RecordBatch.from_arrays(
        [pa.array(cn), pa.array(c), pa.array(np.full(n, pid, dtype=np.int32)),
         pa.array(np.arange(seg, seg + n)), _lists(tn, first), _lists(t, first),
         pa.ListArray.from_arrays(pa.array(first.astype(np.int32)),
                                  pa.array(h.tolist(), type=pa.binary()).cast(pa.string())),
         _lists(kind, first), _lists(fault, first), _lists(m.reshape(-1), np.arange(n + 1) * 16),
         total(fault == BLANK), total(fault == DUPLICATE), total(fault == TRUNCATED), total(bad),
         edge(kind, every, False), edge(kind, every, True), edge(t, turn, False), edge(t, turn, True),
         total(fresh)],
        [x.split()[0] for x in SEGMENTS.split(", ")])


def _segments(rows: DataFrame) -> DataFrame:
    def cut(batches):
        pid, seg = TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = _columns(b, *KEYS, "tn", "t", "kind", "fault", "n")
            cn, c, tn, t, kind, fault, n = cols
            h = _hex(b.column("h"))
            ends = np.cumsum(np.maximum(n, 1))
            for lo in range(0, int(ends[-1]), PIECE):
                pos = np.arange(lo, min(lo + PIECE, int(ends[-1])))
                at = np.searchsorted(ends, pos, side="right")
                copy = pos - (ends[at] - np.maximum(n[at], 1)) > 0    # of a row before it
                again = copy & (fault[at] != BLANK)
                out = _segment_batch(pid, seg, cn[at], c[at], tn[at], t[at], h[at], kind[at],
                                     np.where(again, DUPLICATE, fault[at]).astype(np.int32), n[at] == 0)
                seg += out.num_rows
                yield out

    order = [*KEYS, "tn", "t", "role", "h"]
    return materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                       .mapInArrow(cut, SEGMENTS), "turn_segments")


def _runs(b: pa.RecordBatch):
    """(conversation key, index) of each row of a batch, in order."""
    cn, c = _columns(b, *KEYS)
    return zip(cn.tolist(), c.tolist())


def _end_costs(segments: DataFrame) -> DataFrame:
    """(pid, seg, v, final, cost): the least cost from each state at the end of
    a segment, whether it is its conversation's last, and the cost from its
    start without a row before.  Segments of a conversation arrive last first."""
    def back(batches):
        key, v = None, None
        for b in batches:
            m = b.column("m").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 4)
            out, final, cost = [], [], []
            for k, x in zip(_runs(b), m):
                final.append(k != key)
                if k != key:
                    key, v = k, LAST
                out.append(v)
                v = (x + v).min(axis=1)
                cost.append(int(v[0]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [b.column("pid"), b.column("seg"),
                     _lists(np.concatenate(out), np.arange(len(out) + 1) * 4), pa.array(final),
                     pa.array(cost)], ["pid", "seg", "v", "final", "cost"])

    return segments.select(*KEYS, "pid", "seg", "m").repartition(*KEYS) \
        .sortWithinPartitions(*KEYS, F.desc("pid"), F.desc("seg")) \
        .mapInArrow(back, "pid int, seg long, v array<long>, final boolean, cost long")


# -------------------------------------------------------------------- audit

class Nodes:
    """The nodes (segment, rows done, state) of a batch of segments and their
    optimal arcs.  Node ids: 4 x (place of the row) + state; a segment of n
    rows has n + 1 places."""

    def __init__(self, kind, fault, first, ends, final):
        size = np.diff(first)
        self.base = first[:-1] + np.arange(len(size))        # first place of each segment
        self.tail = self.base + size                         # the place after its last row
        places = int(first[-1]) + len(size)
        v = np.zeros((places, 4), dtype=np.int64)
        v[self.tail] = ends
        for i in range(int(size.max(initial=0))):            # from the last row backwards
            on = np.flatnonzero(size > i)
            row = first[on + 1] - 1 - i
            place = self.tail[on] - 1 - i
            v[place] = (STEP[kind[row], fault[row]] + v[place + 1][:, None, :]).min(axis=2)
        self.v = v
        owner = np.repeat(np.arange(len(size)), size + 1)
        place = np.arange(places)
        inner = place < self.tail[owner]
        row = np.where(inner, place - owner, 0)              # the row that is next
        role = np.where(inner, kind[row] if len(kind) else 0, 3)
        slip = np.where(inner, fault[row] if len(fault) else 0, 0)
        free = inner & (slip != BLANK) & (slip != DUPLICATE)
        extra = (slip == TRUNCATED).astype(np.int64)
        kept = np.full((4, 4), -1)                           # [role, state]: state
        for s, arcs in KEPT.items():
            for r, t in arcs.items():
                kept[r, s] = t
        self.target = np.full((4, places * 4), -1, dtype=np.int64)      # by edit, D I K R
        after = np.where(inner, place + 1, place)
        for s in range(4):
            node = place * 4 + s
            here = v[:, s]
            due = NEXT[s]
            ok = inner & (here == 3 + v[after, s])
            self._arc(DELETE, node, after * 4 + s, ok)
            ok = (inner | final[owner]) & (here == 2 + v[:, due])
            self._arc(INSERT, node, place * 4 + due, ok)
            to = kept[role, s]
            ok = free & (to >= 0) & (here == extra + v[after, np.maximum(to, 0)])
            self._arc(KEEP, node, after * 4 + to, ok)
            ok = free & (here == 2 + extra + v[after, due])
            self._arc(REROLE, node, after * 4 + due, ok)

    def _arc(self, edit: int, node, target, ok) -> None:
        self.target[edit - 1, node[ok]] = target[ok]

    def ranks(self) -> np.ndarray:
        """Rank of each node by the least audit from it, by prefix doubling; a
        node without an arc ends its audit and comes first."""
        arcs = self.target >= 0
        some = arcs.any(axis=0)
        edit = np.where(some, arcs.argmax(axis=0), 0)        # the least edit
        own = np.arange(len(some))
        ahead = np.where(some, self.target[edit, own], own)
        rank = np.where(some, edit + 1, 0)
        while True:
            pair = rank * (int(rank.max(initial=0)) + 1) + rank[ahead]
            _, rank = np.unique(pair, return_inverse=True)   # for twice as many edits
            further = ahead[ahead]
            if (further == ahead).all():
                return rank
            ahead = further

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """(edit, next node) by the least (edit, rank of the next node); edit 0
        and the node itself where the audit ends."""
        rank = self.ranks()
        wide = int(rank.max(initial=0)) + 1
        key = np.where(self.target >= 0, np.arange(4)[:, None] * wide + rank[self.target], 4 * wide)
        best = key.argmin(axis=0)
        own = np.arange(key.shape[1])
        ends = key[best, own] == 4 * wide
        return np.where(ends, 0, best + 1), np.where(ends, own, self.target[best, own])

    def paths(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, offsets, end nodes) of the paths from the nodes ``start``.
        Codes: D, K, u and a for a rerole, U and A for an insertion."""
        edit, ahead = self.steps()
        length = (edit > 0).astype(np.int64)
        levels = [ahead]                                     # 1, 2, 4, ... edits on
        while not (levels[-1][levels[-1]] == levels[-1]).all():
            length = length + length[levels[-1]]
            levels.append(levels[-1][levels[-1]])
        length = length + length[levels[-1]]
        offs = np.concatenate(([0], np.cumsum(length[start])))
        node = np.repeat(start, length[start])
        at = _local(offs)
        for k, jump in enumerate(levels):
            move = (at >> k) & 1 == 1
            node[move] = jump[node[move]]
        due = NEXT[node % 4] == 2                            # a user turn is due
        code = np.select([edit[node] == DELETE, edit[node] == KEEP, (edit[node] == REROLE) & due,
                          edit[node] == REROLE, due], [ord(x) for x in "DKuaU"], ord("A"))
        end = levels[-1][levels[-1][start]]
        return code.astype(np.uint8), offs, end


def _strings(codes: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int32).tobytes()),
                                       pa.py_buffer(codes.tobytes()))


def _segment_paths(segments: DataFrame) -> DataFrame:
    """(..., exits, paths): by the state in which a segment is entered, the
    state in which it is left and its edits."""
    ends = _end_costs(segments)
    names = [*KEYS, "pid", "seg", "tn", "t", "h"]
    kinds = dict(segments.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) \
        + ", cost long, exits array<int>, paths array<string>"

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("kind")
            first = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            kind, fault = (b.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("kind", "fault"))
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            final = b.column("final").to_numpy(zero_copy_only=False)
            nodes = Nodes(kind, fault, first, v, final)
            start = (nodes.base[:, None] * 4 + np.arange(4)).reshape(-1)
            codes, offs, end = nodes.paths(start)
            four = pa.array((np.arange(b.num_rows + 1) * 4).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(x) for x in names), b.column("cost"),
                 pa.ListArray.from_arrays(four, pa.array((end % 4).astype(np.int32))),
                 pa.ListArray.from_arrays(four, _strings(codes, offs))],
                [*names, "cost", "exits", "paths"])

    return materialize(segments.join(ends, ["pid", "seg"]).mapInArrow(work, schema), "turn_paths")


def _entries(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """(pid, seg, entry, head, border, shared): the state in which the least
    path enters each segment, whether it is its conversation's first, and
    whether its first row is an illegal neighbour of, or has the turn of, the
    row before it."""
    def forward(batches):
        key, state, kind, turn = None, 0, None, None
        for b in batches:
            out = {x: [] for x in ("entry", "head", "border", "shared")}
            cols = [b.column(x).to_pylist() for x in ("exits", "first", "last", "low", "high")]
            for k, exits, first, last, low, high in zip(_runs(b), *cols):
                out["head"].append(k != key)
                if k != key:
                    key, state, kind, turn = k, 0, None, None
                out["entry"].append(state)
                out["border"].append(int(None not in (kind, first) and not LEGAL[kind, first]))
                out["shared"].append(int(None not in (turn, low) and turn == low))
                state = exits[state]
                kind, turn = (kind if last is None else last), (turn if high is None else high)
            if b.num_rows:
                kinds = dict(entry=pa.int32(), head=pa.bool_(), border=pa.int64(), shared=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("pid"), b.column("seg"), *(pa.array(v, type=kinds[x]) for x, v in out.items())],
                    ["pid", "seg", *out])

    ends = segments.select("pid", "seg", "first", "last", "low", "high")
    return paths.select(*KEYS, "pid", "seg", "exits").join(ends, ["pid", "seg"]) \
        .repartition(*KEYS).sortWithinPartitions(*KEYS, "pid", "seg") \
        .mapInArrow(forward, "pid int, seg long, entry int, head boolean, border long, shared long")


# ------------------------------------------------------------------ results

class Repairs:
    """Segments with their chosen edits; what the results are made from."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        thin = materialize(_thin(rows), "turn_rows")
        self.segments = _segments(_with_duplicates(thin))
        paths = _segment_paths(self.segments)
        chosen = paths.join(_entries(self.segments, paths), ["pid", "seg"])
        self.chosen = materialize(chosen.select(
            *KEYS, "pid", "seg", "tn", "t", "h", "cost", "head", "border", "shared",
            F.get("paths", F.col("entry")).alias("path")), "turn_edits")

    def turns(self) -> DataFrame:
        """cn, c, pid, seg, at, role, text, edit: the repaired turns, in the
        order of (pid, seg, at)."""
        schema = "cn int, c long, pid int, seg long, at long, tn int, t long, h string, code string"

        def unfold(batches):
            for b in batches:
                path = b.column("path").cast(pa.large_binary())
                code = np.frombuffer(b"".join(path.to_pylist()), dtype=np.uint8)
                size = np.array([len(x) for x in path.to_pylist()], dtype=np.int64)
                first = np.concatenate(([0], np.cumsum(size)))
                owner = np.repeat(np.arange(len(size)), size)
                own = (code != ord("U")) & (code != ord("A"))           # edits of a row
                row = np.cumsum(own) - 1
                stays = code != ord("D")
                pick = np.where(own, row, 0)[stays]
                some = pa.array(pick, mask=~own[stays])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(x).take(pa.array(owner[stays])) for x in ("cn", "c", "pid", "seg")),
                     pa.array(_local(first)[stays]),
                     *(b.column(x).flatten().take(some) for x in ("tn", "t", "h")),
                     pa.array([chr(x) for x in code[stays]], type=pa.string())],
                    [x.split()[0] for x in schema.split(", ")])

        edits = self.chosen.select(*KEYS, "pid", "seg", "tn", "t", "h", "path").mapInArrow(unfold, schema)
        # equal rows are one before they travel
        texts = _keyed(self.rows).filter("copies > 0").groupBy(*KEYS, "tn", "t", "h") \
            .agg(F.first("role").alias("role"), F.first("text").alias("text"))
        due = F.when(F.upper("code") == "U", "user").when(F.upper("code") == "A", "assistant")
        place = [*KEYS, "pid", "seg", "at"]
        old = edits.filter("h is not null").join(texts, [*KEYS, "tn", "t", "h"])
        new = edits.filter("h is null").select(*place, due.alias("role"), F.lit("").alias("text"),
                                               F.lit("I").alias("edit"))
        return old.select(*place, F.coalesce(due, "role").alias("role"), "text",
                          F.when(F.col("code") == "K", "K").otherwise("R").alias("edit")).unionByName(new)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, position, role, text, edit: the turns of the repaired
    conversations, numbered from 0."""
    t = Repairs(rows).turns()
    order = Window.partitionBy(*KEYS).orderBy("pid", "seg", "at")
    return t.select(F.when(F.col("cn") == 1, F.col("c")).alias("conv_id"),
                    (F.row_number().over(order) - 1).cast("long").alias("position"), "role", "text", "edit")


def _hashes(turns: DataFrame) -> DataFrame:
    """(cn, c, sha): SHA-256 of ``role:text`` lines, fed in order."""
    def feed(batches):
        key, sha = None, None
        for b in batches:
            done = []
            for k, line in zip(_runs(b), b.column("line").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(line.encode())
                else:
                    sha.update(b"\n" + line.encode())
            if done:
                yield _hash_batch(done)
        if key is not None:
            yield _hash_batch([(*key, sha.hexdigest())])

    return turns.select(*KEYS, "pid", "seg", "at", F.concat("role", F.lit(":"), "text").alias("line")) \
        .repartition(*KEYS).sortWithinPartitions(*KEYS, "pid", "seg", "at") \
        .mapInArrow(feed, "cn int, c long, sha string")


def _hash_batch(done: list) -> pa.RecordBatch:
    cn, c, sha = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(cn, type=pa.int32()), pa.array(c, type=pa.int64()),
                                       pa.array(sha)], ["cn", "c", "sha"])


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 of each conversation of rows (conv_id, turn, role, text
    and, if present, copies)."""
    r = Repairs(rows)
    counts = r.segments.groupBy(*KEYS).agg(
        *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "turns")),
        F.min("low").alias("low"), F.max("high").alias("high"))
    # one audit piece per segment
    audits = r.chosen.groupBy(*KEYS).agg(
        F.max(F.when(F.col("head"), F.col("cost"))).alias("cost"), F.sum("border").alias("border"),
        F.sum("shared").alias("shared"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
            "pid", "seg", F.translate("path", "uaUA", "RRII").alias("audit")))), lambda x: x["audit"]), "")
        .alias("audit"))
    gaps = F.col("high") - F.col("low") + 1 - (F.col("turns") - F.col("shared"))
    return counts.join(audits, KEYS).join(_hashes(r.turns()), KEYS, "left").select(
        F.when(F.col("cn") == 1, F.col("c")).alias("conv_id"), F.coalesce(gaps, F.lit(0)).alias("gaps"),
        "blank", "duplicate", "truncated", (F.col("illegal") + F.col("border")).alias("illegal"), "cost",
        "audit", F.coalesce("sha", F.lit(EMPTY)).alias("repaired_sha256"))
