"""Row filters and page-listing extraction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commsim.session import small


def in_values(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Rows whose ``column`` is one of the literals; the test is case-sensitive and reaches the scan."""
    return df.where(F.col(column).isin(sorted(set(values))))


def in_joined_values(df: DataFrame, column: str, values: str) -> DataFrame:
    """Like :func:`in_values`, for literals given as one comma-separated string."""
    return in_values(df, column, values.split(","))


def not_value(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose ``column`` differs from ``value``; nulls drop out."""
    return df.where(F.col(column) != F.lit(value))


def in_list(df: DataFrame, column: str, names: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose ``column`` occurs in the stored list ``names``."""
    return df.join(small(names.select(F.col(name).alias(column))), column, "left_semi")


def listing_entries(
    pages: DataFrame,
    number: str,
    html: str,
    begin: str,
    end: str,
    entry: str,
    flag: str,
    flag_value: str,
    name: str,
    num_pages: int | None = None,
) -> DataFrame:
    """Names of flagged entries in the listing block of each page, in page order.

    The block runs from the first ``begin`` to the next ``end``. ``entry`` matches one entry's tag,
    ``flag`` and ``name`` capture its attributes; entries that lack one are skipped. ``num_pages``
    keeps the pages numbered below it. ``(number, position)`` gives the order, names may repeat.
    """
    if num_pages is not None:
        pages = pages.where(F.col(number) < num_pages)
    at = F.locate(begin, F.col(html))
    after = F.when(at > 0, F.substr(F.col(html), at + len(begin)))
    block = F.substring_index(after, end, 1)
    entries = pages.select(number, F.posexplode_outer(F.regexp_extract_all(block, F.lit(entry), F.lit(0))))
    found = entries.select(
        number,
        F.col("pos").alias("position"),
        F.regexp_extract("col", flag, 1).alias("flag"),
        F.regexp_extract("col", name, 1).alias("name"),
    )
    return found.where((F.col("flag") == flag_value) & (F.col("name") != "")).drop("flag")
