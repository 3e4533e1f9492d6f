"""String and ``|``-list expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a mention is "r/", any one character, then a run without these delimiters. The code points
# after \s complete Unicode whitespace, which \s alone leaves out.
MENTION = (
    r"r/[^\n][^()\].\s:+\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
)


def split_list(column: Column) -> Column:
    """Parts of a ``|``-joined string; the empty string has one empty part."""
    return F.split(column, "[|]", -1)


def strip_non_ascii(column: Column) -> Column:
    return F.regexp_replace(column, r"[^\x00-\x7F]", "")


def mentions(text: Column) -> Column:
    """All raw mentions in ``text``, prefix included."""
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))


def mention_name(mention: Column) -> Column:
    """The name in a raw mention: without the prefix, up to the first slash after its first character."""
    return F.regexp_extract(F.substr(mention, F.lit(3)), r"^([\s\S][^/]*)", 1)


def substrings(text: Column, min_length: int = 1) -> Column:
    """Array of ``{start, sub}`` for all substrings of at least ``min_length``; ``start`` counts from 0."""

    def from_start(start: Column) -> Column:
        lengths = F.sequence(F.lit(min_length), F.length(text) - start)
        return F.transform(
            lengths, lambda n: F.struct(start.alias("start"), F.substr(text, start + 1, n).alias("sub"))
        )

    starts = F.sequence(F.lit(0), F.length(text) - min_length)
    return F.when(F.length(text) >= min_length, F.flatten(F.transform(starts, from_start)))
