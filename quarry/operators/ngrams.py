"""Counted word n-grams of slices of token arrays, inside a task.

A slice's tokens are dictionary-encoded once; stop words are found in the
dictionary, and an n-gram is the pair of its first n - 1 words' number and its
last word's, so text is made once for each distinct n-gram of a slice only.
Tokens hold no white space, so different word sequences never give the same text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens whose arrays are held at once, beside the batch that Spark sends.
SLICE_TOKENS = 1 << 18


def lengths(col) -> np.ndarray:
    return np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)


def token_slices(batches, column: int = 1, most: int = SLICE_TOKENS):
    """Batches cut so that a slice's token arrays hold at most ``most`` tokens
    (one longer array makes a slice of its own)."""
    for b in batches:
        end = np.cumsum(lengths(b.column(column)))
        lo = 0
        while lo < b.num_rows:
            done = end[lo - 1] if lo else 0
            hi = max(int(np.searchsorted(end, done + most, side="right")), lo + 1)
            yield b.slice(lo, hi - lo)
            lo = hi


def slice_ngrams(col, ngram: tuple[int, int], stop_words):
    """(row, number, text by number) of all n-grams of a token-list column,
    without the stop words; null lists and null tokens count as none."""
    row, flat = np.repeat(np.arange(len(col)), lengths(col)), col.flatten()
    coded = flat.dictionary_encode()
    words = coded.dictionary
    code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    drop = pc.is_in(words, value_set=pa.array(stop_words, type=words.type)).to_numpy(zero_copy_only=False)
    keep = (code >= 0) & ~np.append(drop, True)[code]
    row, code = row[keep], code[keep]
    gram, first, text = code, np.arange(len(code)), words
    rows, numbers, texts, n_texts = [], [], [], 0
    for n in range(1, ngram[1] + 1):
        if n > 1:
            # the (n-1)-gram at a place and the word after it, in one row
            last = first + n - 1
            ok = last < len(code)
            ok[ok] = row[first[ok]] == row[last[ok]]
            first, gram = first[ok], gram[ok]
            pair, gram = np.unique(gram * max(len(words), 1) + code[first + n - 1], return_inverse=True)
            text = pc.binary_join_element_wise(text.take(pa.array(pair // max(len(words), 1))),
                                               words.take(pa.array(pair % max(len(words), 1))), " ")
        if n >= ngram[0]:
            rows.append(row[first])
            numbers.append(gram + n_texts)
            texts.append(text)
            n_texts += len(text)
    return np.concatenate(rows), np.concatenate(numbers), pa.concat_arrays(texts)
