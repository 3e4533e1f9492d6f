"""Fusion of the text, user and metadata scores of community pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commsim.operators.index import DenseIndex
from commsim.operators.pairs import pair_spine

# Weights of the four scores in the total.
NGRAM_WEIGHT = 0.3
AUTHOR_JACCARD_WEIGHT = 0.3
USER_WEIGHT = 0.3
META_WEIGHT = 0.1


def one_per_pair(scores: DataFrame, *values: str, order: str = "ord", keep: str = "last") -> DataFrame:
    """One entry per unordered pair ``(a, b)``, ``a < b``: the first or the last by ``order``.

    Entries may name a pair in either orientation and more than once.
    """
    pick = F.max_by if keep == "last" else F.min_by
    chosen = scores.groupBy(F.least("s1", "s2").alias("a"), F.greatest("s1", "s2").alias("b")).agg(
        pick(F.struct(*values), F.col(order)).alias("entry")
    )
    return chosen.select("a", "b", *[F.col(f"entry.{v}").alias(v) for v in values])


def fuse(communities: DenseIndex, text: DataFrame, user: DataFrame, meta: DataFrame) -> DataFrame:
    """Weighted scores and their total for every pair of listed communities; absent scores count 0.

    For score files, which name a pair in either orientation and repeat it: ``text`` has ``s1, s2, ngram, user``, the
    others ``s1, s2, score``; each has an ``ord`` for its entries. Of several entries for a pair, text takes the
    first, user and metadata the last.
    """
    keys = ["a", "b"]
    spine = pair_spine(communities).withColumn("a", F.least("s1", "s2")).withColumn("b", F.greatest("s1", "s2"))
    joined = (
        spine.join(one_per_pair(text, "ngram", "user", keep="first"), keys, "left")
        .join(one_per_pair(user.withColumnRenamed("score", "user_score"), "user_score"), keys, "left")
        .join(one_per_pair(meta.withColumnRenamed("score", "meta_score"), "meta_score"), keys, "left")
    )
    return weigh(joined).drop("i", "j")


def weigh(scores: DataFrame) -> DataFrame:
    """The weighted scores and their total of rows with ``i, j, s1, s2, ngram, user, user_score, meta_score``; nulls count 0."""
    weighted = scores.na.fill(0.0, ["ngram", "user", "user_score", "meta_score"]).select(
        "i",
        "j",
        "s1",
        "s2",
        (F.col("ngram") * NGRAM_WEIGHT + F.col("user") * AUTHOR_JACCARD_WEIGHT).alias("text"),
        (F.col("user_score") * USER_WEIGHT).alias("user"),
        (F.col("meta_score") * META_WEIGHT).alias("meta"),
    )
    return weighted.withColumn("total", F.col("text") + F.col("user") + F.col("meta"))
