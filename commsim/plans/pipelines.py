"""The pipelines end to end: posts to vectors, text, user and metadata scores, and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commsim.operators import baskets, fuse, index, meta, pairs, text
from commsim.operators.index import DenseIndex
from commsim.session import materialize


def ngram_overlaps(posts: DataFrame, communities: DenseIndex, n: int = 2) -> DataFrame:
    """Shared n-grams of all listed communities; ordinals join the posts before their grams unfold."""
    grams = text.ngram_occurrences(pairs.with_ordinals(posts, communities), "ord", n=n)
    return materialize(pairs.overlaps(grams, communities.size, "ngram"), "overlaps")


def _community_grams(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each n-gram with its communities, ``(ngram, parts)``, and their names ``(ord, subreddit)``; posts of no community are one of their own."""
    communities = pairs.community_index(posts)
    known = communities.bounded(communities.frame.withColumnRenamed("community", "subreddit"))
    placed = posts.join(known, "subreddit", "left").withColumn("ord", F.coalesce("ord", F.lit(communities.size).cast("long")))
    grams = pairs.memberships(text.ngram_occurrences(placed, "ord"), communities.size + 1, "ngram")
    nameless = posts.sparkSession.createDataFrame([(communities.size, None)], "ord long, subreddit string")
    named = communities.frame.select("ord", F.col("community").alias("subreddit")).union(nameless)
    return grams, communities.bounded(named)


def posts_to_edges(posts: DataFrame) -> DataFrame:
    """Distinct ``(subreddit, ngram)`` edges, unfolded where each n-gram's communities are."""
    grams, named = _community_grams(posts)
    return pairs.member_rows(grams, "ngram").join(named, "ord").select("subreddit", "ngram")


def posts_to_components(posts: DataFrame) -> DataFrame:
    """The components ``(subreddit, index)`` of all edges; each gram carries its communities while it is numbered."""
    grams, named = _community_grams(posts)
    vocabulary = index.number_rows(grams, "ngram")
    return pairs.member_rows(vocabulary.frame, "index").join(named, "ord").select("subreddit", "index")


def author_overlaps(
    posts: DataFrame, communities: DenseIndex, exclude_author: str | None = None, support: float = 0.0
) -> DataFrame:
    """Shared authors of all listed communities, optionally without one author and without overlaps below ``support``."""
    rows = posts.select("subreddit", "author")
    if exclude_author is not None:
        rows = rows.where(F.col("author") != F.lit(exclude_author))
    return pairs.pair_overlaps(rows, communities, "author", support=support)


def posts_to_vectors(posts: DataFrame, communities: DenseIndex, block: int = 4096) -> DataFrame:
    """Binary n-gram vectors of all listed communities, in blocks of dimensions.

    Each gram carries its communities while it is numbered, which saves joining edges and index.
    """
    grams = text.ngram_occurrences(pairs.with_ordinals(posts, communities), "ord")
    vocabulary = index.number_rows(pairs.memberships(grams, communities.size, "ngram"), "ngram")
    cells = pairs.member_rows(vocabulary.frame, "index")
    vectors = index.community_vectors(cells, vocabulary.size, block, community="ord")
    named = communities.frame.select("ord", F.col("community").alias("subreddit"))
    return vectors.join(communities.bounded(named), "ord").select("subreddit", "block", "size", "indices")


def text_scores(grams: DataFrame, authors: DataFrame, communities: DenseIndex) -> DataFrame:
    """2-gram and author Jaccard of every listed pair, from their overlaps: ``(i, j, s1, s2, ngram, user)``."""
    user = pairs.jaccard(authors, communities).select("i", "j", F.col("jaccard").alias("user"))
    ngram = pairs.jaccard(grams, communities).select("i", "j", "s1", "s2", F.col("jaccard").alias("ngram"))
    return ngram.join(user, ["i", "j"])


def without_author(counts: DataFrame, posts: DataFrame, communities: DenseIndex, author: str) -> DataFrame:
    """Author overlaps without one author: a pair loses one where the author is in both communities."""
    own = pairs.with_ordinals(posts.where(F.col("author") == author).select("subreddit").distinct(), communities).select("ord")
    own = materialize(own, "author")
    first = own.select(F.col("ord").alias("i"), F.lit(1).alias("in_i"))
    second = own.select(F.col("ord").alias("j"), F.lit(1).alias("in_j"))
    joined = counts.join(first, "i", "left").join(second, "j", "left")
    left = F.col("common") - F.coalesce(F.col("in_i") * F.col("in_j"), F.lit(0))
    return joined.select("i", "j", left.alias("common")).where("common > 0")


def user_pairs(posts: DataFrame, communities: DenseIndex, support: float = 0.0, exclude_author: str | None = "[deleted]") -> DataFrame:
    """Pairs of communities with common authors, and their counts."""
    return baskets.pair_counts(author_overlaps(posts, communities, exclude_author, support), communities, support)


def user_scores(posts: DataFrame, communities: DenseIndex, support: float = 0.0, exclude_author: str | None = "[deleted]") -> DataFrame:
    """User score of every pair with a common author: ``(s1, s2, score)``."""
    return baskets.user_cosine(user_pairs(posts, communities, support, exclude_author))


def fused_scores(
    texts: DataFrame,
    posts: DataFrame,
    affixes: DataFrame,
    mods: DataFrame,
    mentioned: DataFrame,
    words: DataFrame,
    communities: DenseIndex,
    deleted: str = "[deleted]",
) -> DataFrame:
    """All signals of every pair of listed communities: ``(s1, s2, text, user, meta, total)``.

    Titles come from ``texts``, authors from ``posts``; both are read once. Of the two directed metadata scores of a
    pair the later in list order counts, so only pairs whose target stands behind the other are scored.
    """
    authors = author_overlaps(posts, communities)
    text = text_scores(ngram_overlaps(texts, communities), authors, communities)
    counts = materialize(without_author(authors, posts, communities, deleted), "overlaps")
    sizes = counts.where("i = j")
    n1, n2 = (sizes.select(F.col("i").alias(o), F.col("common").alias(n)) for o, n in (("i", "n1"), ("j", "n2")))
    product = (F.col("common") / F.col("n1")) * (F.col("common") / F.col("n2"))
    user = counts.where("i < j").join(n1, "i").join(n2, "j").select("i", "j", F.sqrt(product).alias("user_score"))
    later = pairs.directed_pairs(communities).where("i > j")
    affix = meta.affix_scores(affixes, communities, words, pairs=later)
    mention, moderator = meta.mention_scores(mentioned, communities), meta.moderator_scores(mods, communities)
    joined = text.join(user, ["i", "j"], "left")
    for score in (affix, mention, moderator):
        turned = score.where("i > j").select(F.col("j").alias("i"), F.col("i").alias("j"), score.columns[-1])
        joined = joined.join(turned, ["i", "j"], "left")
    joined = joined.na.fill(0.0, ["affix", "mention", "moderator"])
    total = F.col("affix") * meta.AFFIX_WEIGHT + F.col("mention") * meta.MENTION_WEIGHT + F.col("moderator") * meta.MODERATOR_WEIGHT
    return fuse.weigh(joined.withColumn("meta_score", total)).drop("i", "j")
