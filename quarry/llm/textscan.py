"""Byte-level text scanning over Arrow batches with NumPy.

A batch's texts are one contiguous buffer, so words, lines and their hashes
are found for all documents of a slice at once, without a loop over rows.
White space is the ASCII set [\\x20\\x09-\\x0D]; a null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = bytes(int(b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
WORD = r"[^\x20\x09-\x0D]+"

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice's texts take about ``max_bytes`` (one long
    text makes a slice of its own); bounds the NumPy arrays made per slice."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = _offsets(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(ends, ends[lo] + max_bytes, side="right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _binary(col: pa.Array) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.large_binary())


def _offsets(col: pa.Array) -> np.ndarray:
    b = _binary(col)
    return np.frombuffer(b.buffers()[1], dtype=np.int64)[b.offset: b.offset + len(b) + 1]


class Texts:
    """The texts of a slice: ``buf`` (uint8), text i in buf[offs[i]:offs[i+1]]."""

    def __init__(self, col: pa.Array, lower: bool = False):
        b = _binary(col)
        offs = _offsets(b)
        data = b.buffers()[2]
        raw = b"" if data is None else memoryview(data)[int(offs[0]):int(offs[-1])].tobytes()
        self.raw = raw.translate(LOWER) if lower else raw
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        self.offs = (offs - offs[0]).astype(np.int64)
        if b.null_count:  # a null may still own bytes in a sliced buffer
            sizes = np.diff(self.offs)
            null = np.asarray(b.is_null().to_numpy(zero_copy_only=False))
            if sizes[null].any():
                keep = np.repeat(~null, sizes)
                self.raw = self.buf[keep].tobytes()
                self.buf = np.frombuffer(self.raw, dtype=np.uint8)
                self.offs = np.concatenate(([0], np.cumsum(np.where(null, 0, sizes))))
        self.n = len(b)

    @classmethod
    def cut(cls, raw: bytes, offs: np.ndarray) -> Texts:
        """``raw`` as texts that begin at ``offs``, its length last."""
        t = cls.__new__(cls)
        t.raw, t.buf, t.offs, t.n = raw, np.frombuffer(raw, dtype=np.uint8), offs, len(offs) - 1
        return t

    def text(self, i: int) -> bytes:
        return self.raw[self.offs[i]:self.offs[i + 1]]

    def words(self, blank: bytes = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, first): word byte ranges in buf, and for each text the
        index of its first word (n + 1 entries).  ``blank``: 1 for each byte
        value that separates words."""
        if not len(self.buf):
            z = np.zeros(0, dtype=np.int64)
            return z, z, np.zeros(self.n + 1, dtype=np.int64)
        solid = np.frombuffer(self.raw.translate(blank), dtype=np.uint8) == 0
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        # words stop at text borders too
        edge = self.offs[1:-1]
        edge = edge[(edge > 0) & (edge < len(self.buf))]
        begins[edge] = solid[edge]
        ends[edge - 1] = solid[edge - 1]
        start = np.flatnonzero(begins)
        end = np.flatnonzero(ends) + 1
        return start, end, np.searchsorted(start, self.offs)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, first): \\n-split lines; an empty text has one empty line."""
        nl = np.flatnonzero(self.buf == 10)
        owner = np.searchsorted(self.offs, nl, side="right") - 1
        counts = np.bincount(owner, minlength=self.n).astype(np.int64) + 1 if self.n else \
            np.zeros(0, dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(counts)))
        start = np.empty(first[-1], dtype=np.int64)
        end = np.empty(first[-1], dtype=np.int64)
        heads, tails = first[:-1], first[1:] - 1
        inner = np.ones(first[-1], dtype=bool)
        inner[heads] = False
        start[heads] = self.offs[:-1]
        start[inner] = nl + 1
        outer = np.ones(first[-1], dtype=bool)
        outer[tails] = False
        end[tails] = self.offs[1:]
        end[outer] = nl
        return start, end, first


def range_hash(raw: bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range raw[start:end], 8 bytes at a time; the
    ranges still running after a step are the only ones the next step touches."""
    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    if not len(start):
        return h
    padded = raw + b"\0" * 8
    words8 = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    todo = np.flatnonzero(size > 0)
    at, left = start[todo], size[todo]
    while len(todo):
        v = words8[at]
        short = left < 8
        if short.any():
            keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
            v = v & keep
        h[todo] = mix(h[todo] ^ v)
        go = left > 8
        todo, at, left = todo[go], at[go] + 8, left[go] - 8
    return h


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first) of the k-word shingles of each text from its word hashes.
    A text of 1 to k-1 words has one shingle, of all its words."""
    n_words = np.diff(first)
    counts = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    sfirst = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(sfirst[-1]) + np.repeat(first[:-1] - sfirst[:-1], counts)
    last = np.repeat(first[1:], counts)
    out = np.zeros(len(at), dtype=np.uint64)
    pad = np.concatenate((h, np.zeros(k, dtype=np.uint64)))
    for j in range(k):
        inside = at + j < last
        nxt = mix(out + pad[at + j] + np.uint64(j + 1))
        out = nxt if inside.all() else np.where(inside, nxt, out)
    return out, sfirst
