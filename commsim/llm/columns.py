"""Names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
