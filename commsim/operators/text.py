"""Posts to tokens, n-grams and (community, gram) edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commsim.functions import text as fn

SPLIT_BYTES = 32 * 1024 * 1024


def token_rows(posts: DataFrame, *keys: str, title: str = "title", keep_last_char: bool = False) -> DataFrame:
    """``keys`` and the ``tokens`` array of each post that has a title."""
    titled = posts.where(F.col(title).isNotNull())
    return titled.select(*keys, fn.tokens(F.col(title), keep_last_char).alias("tokens"))


def ngram_rows(posts: DataFrame, *keys: str, title: str = "title", n: int = 2, keep_last_char: bool = False) -> DataFrame:
    """``keys`` and the ``ngrams`` array of each post that has a title."""
    titled = posts.where(F.col(title).isNotNull())
    return titled.select(*keys, fn.ngrams(fn.tokens(F.col(title), keep_last_char), n).alias("ngrams"))


def ngram_occurrences(posts: DataFrame, *keys: str, title: str = "title", n: int = 2) -> DataFrame:
    """One row per gram occurrence.

    Texts are dealt to tasks of about :data:`SPLIT_BYTES` first: a task that combines grams holds the different ones of its texts, and
    splits of compressed files can hold any number. The outer explode keeps Spark from inferring a filter that would tokenise every text again.
    """
    posts = posts.select(*keys, title).where(F.col(title).isNotNull())
    size = posts.agg(F.sum(F.octet_length(title))).first()[0] or 0
    if size > SPLIT_BYTES:
        posts = posts.repartition(max(size // SPLIT_BYTES + 1, posts.sparkSession.sparkContext.defaultParallelism))
    exploded = ngram_rows(posts, *keys, title=title, n=n).select(*keys, F.explode_outer("ngrams").alias("ngram"))
    return exploded.where(F.col("ngram").isNotNull())


def ngram_edges(posts: DataFrame, community: str = "subreddit", title: str = "title", n: int = 2) -> DataFrame:
    """Distinct (community, gram) edges; duplicates combine before the shuffle."""
    return ngram_occurrences(posts, community, title=title, n=n).distinct()
