"""Token counts of a unigram vocabulary by count-only Viterbi.

An Aho-Corasick automaton lists every vocabulary piece that ends at each
position, longest first; dynamic programming keeps the best score and the
piece count of its path at each position, never the path itself.  The tie
rules are those of the public unigram tokenizers: a later candidate replaces
an earlier one only with a strictly higher score, candidates come in order of
their start, a character without a piece of its own may be unknown at the
lowest score less 10, and an unknown character counts one piece per byte
where the vocabulary has byte pieces, else one per run of unknowns.

White space becomes the metaspace mark and one mark is put in front.  Where
no piece crosses a border (before a mark run, around a newline; checked on
the vocabulary), the best path passes it, so text is cut there and a
worker remembers the counts of short cuts it has seen (bounded).

The vocabulary (at most ``MAX_PIECES`` pieces) is read once on the driver and
broadcast.  Defined results: a null or empty text has 0 tokens and score 0;
every row keeps its own result; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
UNK_PENALTY = 10.0
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_PIECES = 1_000_000
MEMO_ENTRIES = 200_000
MEMO_CHARS = 64


def load_vocabulary(path: str = DEFAULT_MODEL) -> list[tuple[str, float]]:
    """(piece, score) in id order from a sentencepiece file."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    if n > MAX_PIECES:
        raise ValueError(f"{n} pieces; at most {MAX_PIECES} are broadcast")
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(n)]


class Counter:
    """Piece counts for one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick
        self.auto = ahocorasick.Automaton()
        self.unk = min((s for _, s in pieces), default=0.0) - UNK_PENALTY
        for piece, score in pieces:
            if piece and piece not in self.auto:   # the first id of a piece counts
                self.auto.add_word(piece, (len(piece), score))
        if len(self.auto):
            self.auto.make_automaton()
        names = {p for p, _ in pieces}
        self.bytes_ = all(f"<0x{b:02X}>" in names for b in range(256))
        crossing = any(MARK in p.lstrip(MARK) for p in names)
        newline = any("\n" in p for p in names)
        stop = MARK if newline else MARK + "\n"
        # runs of unknowns that span a cut would count once only
        self.cut = None if crossing or not self.bytes_ else re.compile(
            f"{MARK}+[^{stop}]*|[^{stop}]+" + ("" if newline else "|\n"))
        self.memo: dict[str, tuple[int, float]] = {}

    def viterbi(self, s: str) -> tuple[int, float]:
        """(pieces, score) of the best path over ``s``."""
        n = len(s)
        best = [None] * (n + 1)
        count = [0] * (n + 1)
        in_unk = [False] * (n + 1)     # the path ends in an unknown character
        best[0] = 0.0
        matches = self.auto.iter(s) if len(self.auto) else iter(())
        end, hit = next(matches, (n, None))
        for j in range(1, n + 1):
            top, c, u, single = None, 0, False, False
            while end == j - 1:
                size, score = hit
                i = j - size
                x = best[i] + score
                if size == 1:
                    single = True
                if top is None or x > top:
                    top, c, u = x, count[i] + 1, False
                end, hit = next(matches, (n, None))
            if not single:
                x = best[j - 1] + self.unk
                if top is None or x > top:
                    more = len(s[j - 1].encode("utf-8")) if self.bytes_ else int(not in_unk[j - 1])
                    top, c, u = x, count[j - 1] + more, True
            best[j], count[j], in_unk[j] = top, c, u
        return count[n], best[n]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        s = text.replace(" ", MARK)
        if not s.startswith(MARK):
            s = MARK + s
        if self.cut is None:
            return self.viterbi(s)
        memo, total, score = self.memo, 0, 0.0
        for part in self.cut.findall(s):
            got = memo.get(part)
            if got is None:
                got = self.viterbi(part)
                if len(part) <= MEMO_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[part] = got
            total += got[0]
            score += got[1]
        return total, score


def count_tokens(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_tokens, score (of the best segmentation) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast({"pieces": load_vocabulary(model)})

    def counted(batches):
        state = shared.value        # lives as long as the worker
        if "counter" not in state:
            state["counter"] = Counter(state["pieces"])
        counter = state["counter"]
        for b in batches:
            got = [counter.count(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([n for n, _ in got], type=pa.int64()),
                 pa.array([s for _, s in got], type=pa.float64())],
                ["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        counted, "doc_id long, n_tokens long, score double")
