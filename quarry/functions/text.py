"""Column expressions over text: tokenising, stop words, word n-grams and
per-document term counts.  All built-in Spark functions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split() whitespace set as a Java regex class: \s covers
# [ \t\n\x0B\f\r]; the rest are the other characters Python treats as space.
WHITESPACE_CLASS = (
    "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
)

# The whitespace characters Python splits on that Java's \s does not match;
# they are mapped to a plain space before a fast \s+ split.
EXTRA_WHITESPACE = "".join(chr(c) for c in (
    [0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680] + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_as_string(col, null_text: str = "") -> Column:
    """Text as a string; null becomes ``null_text`` (default empty)."""
    return F.coalesce(_c(col).cast("string"), F.lit(null_text))


def tokenize(col) -> Column:
    r"""Lower-case, split on Unicode whitespace (Python's set), drop empty
    pieces.  Null text stays null.  All built-in, code-generated
    expressions: translate the rare whitespace characters to a space, split
    on \s+, remove the empty strings left at the ends."""
    return split_words(F.lower(_c(col)))


def split_words(col) -> Column:
    """``tokenize`` without lower-casing."""
    spaced = F.translate(_c(col), EXTRA_WHITESPACE, " " * len(EXTRA_WHITESPACE))
    return F.array_remove(F.split(spaced, "\\s+"), "")


def remove_stop_words(tokens, stop_words) -> Column:
    # ``isin`` over a literal list becomes a hash-set lookup (InSet)
    words = sorted(set(stop_words))
    return F.filter(_c(tokens), lambda t: ~t.isin(words))


def word_ngrams(tokens, n: int, sep: str = " ") -> Column:
    """Contiguous n-grams (joined by ``sep``) in order; empty when fewer than n.

    Built by zipping n shifted copies of the array, so each lambda sees only
    its own elements (linear in the array length)."""
    tk = _c(tokens)
    if n == 1:
        return tk
    size = F.size(tk)
    acc = tk
    for i in range(1, n):
        shifted = F.slice(tk, i + 1, F.greatest(size - i, F.lit(0)))
        acc = F.zip_with(acc, shifted, lambda x, y: F.concat(x, F.lit(sep), y))
    return F.slice(acc, 1, F.greatest(size - n + 1, F.lit(0)))


def ngram_range(tokens, low: int, high: int) -> Column:
    """All n-grams for n in [low, high], unigrams first."""
    parts = [word_ngrams(tokens, n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)
