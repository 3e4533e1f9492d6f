"""Tokens and n-grams as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII letters and digits make tokens, everything else separates them.
TOKEN = "[A-Za-z0-9]+"
LONE_LAST_CHARACTER = r"^[^A-Za-z0-9]?[A-Za-z0-9]\z"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column, keep_last_char: bool = False) -> Column:
    """Lower-case ASCII tokens of ``text``.

    A one-character token at the very end of the text is left out unless ``keep_last_char``. Case is
    folded after splitting, so that letters such as the Kelvin sign never become ASCII.
    """
    if not keep_last_char:
        has_lone_tail = F.right(text, F.lit(2)).rlike(LONE_LAST_CHARACTER)
        text = F.when(has_lone_tail, F.left(text, F.length(text) - 1)).otherwise(text)
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def ngrams(words: Column, n: int = 2) -> Column:
    """Sliding windows of ``n`` words joined by a space; up to ``n`` words make one gram, none make none."""

    def windows(w: Column) -> Column:
        size = F.size(w)
        starts = F.slice(w, F.lit(1), size - (n - 1))
        grams = F.transform(starts, lambda _, i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
        return (
            F.when(size == 0, F.array().cast("array<string>"))
            .when(size <= n, F.array(F.array_join(w, " ")))
            .otherwise(grams)
        )

    return bind(words, windows)
