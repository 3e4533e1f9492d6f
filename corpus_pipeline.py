"""A corpus pipeline: toxicity, near-duplicates, benchmark leaks, secrets, and a mixture of the sources.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents that its predecessor kept, and returns a DataFrame; all
but the last return the columns of ``documents``. Between stages the result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commsim.llm import decontamination, mixing, secrets, simhash, toxicity
from commsim.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents with a toxicity score of 0.5 or more."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of fingerprints of three-word shingles linked by two or fewer bits."""
    return simhash.keep_first(docs, radius=simhash.RADIUS, words=simhash.WORDS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a benchmark item, up to a share of edited words."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks credentials that few owners hold; every document stays."""
    return secrets.redact(docs, secrets.repository_of(), secrets.owner_of())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: every document with its source's block and the block's slot."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

# A fitted classifier and a 64-bit hash of shingles are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
