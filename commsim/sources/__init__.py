"""Readers with explicit schemas, and writers, for every format of the pipeline."""

from commsim.sources.files import (
    COMPONENTS,
    METADATA,
    POSTS,
    SCORES,
    TEXT_SCORES,
    number_lines,
    read_baskets,
    read_json,
    read_lines,
    read_metadata,
    read_pair_scores,
    read_parquet,
    read_score_arrays,
    read_words,
    write_baskets,
    write_json,
    write_lines,
    write_metadata,
    write_parquet,
    write_score_array,
)

__all__ = [
    "COMPONENTS",
    "METADATA",
    "POSTS",
    "SCORES",
    "TEXT_SCORES",
    "number_lines",
    "read_baskets",
    "read_json",
    "read_lines",
    "read_metadata",
    "read_pair_scores",
    "read_parquet",
    "read_score_arrays",
    "read_words",
    "write_baskets",
    "write_json",
    "write_lines",
    "write_metadata",
    "write_parquet",
    "write_score_array",
]
