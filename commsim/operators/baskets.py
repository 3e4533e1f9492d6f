"""Author baskets, frequent itemsets of any size, association rules and the user score.

Itemsets of size 2 are counted from the bit masks of :mod:`commsim.operators.pairs`. Larger ones go level by level: candidates come
from two frequent sets with the same beginning, and stay if all their subsets are frequent; an author holds a candidate if it holds both
of these sets. So each level reads the holders of frequent sets alone, and no basket is ever unfolded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commsim.operators.filters import in_list
from commsim.operators.index import DenseIndex
from commsim.operators.pairs import community_index, overlaps, with_ordinals
from commsim.session import materialize, small


def author_edges(posts: DataFrame, exclude_author: str | None = "[deleted]", allowed: DataFrame | None = None) -> DataFrame:
    """Distinct (author, community) edges, without one author such as the marker for deleted accounts.

    ``allowed`` is a written list ``(name)`` of communities; posts elsewhere go before repeats are removed, so that the list
    bounds every author's basket.
    """
    edges = posts.select("author", "subreddit").where("author is not null and subreddit is not null")
    if allowed is not None:
        edges = in_list(edges, "subreddit", allowed)
    if exclude_author is not None:
        edges = edges.where(F.col("author") != F.lit(exclude_author))
    return edges.distinct()


def author_baskets(edges: DataFrame) -> DataFrame:
    """The sorted communities of each author; the allow-list of :func:`author_edges` bounds their number."""
    return edges.groupBy("author").agg(F.sort_array(F.collect_list("subreddit")).alias("communities"))


def item_counts(edges: DataFrame, support: float = 0.0) -> DataFrame:
    """Itemsets of size 1: communities with at least ``support`` authors."""
    counts = edges.groupBy(F.col("subreddit").alias("item")).agg(F.count("*").alias("freq"))
    return counts.where(F.col("freq") >= support)


def prune(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Edges of frequent items only; ``items`` is a written table."""
    return edges.join(small(items.select(F.col("item").alias("subreddit"))), "subreddit", "left_semi")


def pair_counts(counts: DataFrame, communities: DenseIndex, support: float = 0.0) -> DataFrame:
    """Itemsets of size 2 whose items and pair reach ``support``: ``(s1, s2, n1, n2, freq)``.

    ``counts`` comes from :func:`commsim.operators.pairs.pair_overlaps`. Each pair appears once, in list
    order; pairs without a common author do not appear.
    """
    own = counts.where((F.col("i") == F.col("j")) & (F.col("common") >= support)).select(
        F.col("i").alias("ord"), F.col("common").alias("n")
    )
    items = own.join(communities.bounded(communities.frame), "ord")
    first = items.select(F.col("ord").alias("i"), F.col("community").alias("s1"), F.col("n").alias("n1"))
    second = items.select(F.col("ord").alias("j"), F.col("community").alias("s2"), F.col("n").alias("n2"))
    pairs = counts.where((F.col("i") < F.col("j")) & (F.col("common") >= support))
    joined = pairs.join(communities.bounded(first), "i").join(communities.bounded(second), "j")
    return joined.select("s1", "s2", "n1", "n2", F.col("common").alias("freq"))


def candidate_sets(frequent: DataFrame, size: int) -> DataFrame:
    """``(items, left, right)``: the sets of ``size`` (3 or more) all of whose subsets one smaller are in ``frequent``, a written ``(items)``.

    Items are sorted ordinals. ``left`` and ``right`` are the two subsets that lack the last item or the one before it.
    """
    halves = frequent.select("items", F.slice("items", 1, size - 2).alias("begin"), F.element_at("items", -1).alias("last"))
    left = halves.select("begin", F.col("items").alias("left"), F.col("last").alias("low"))
    right = halves.select("begin", F.col("items").alias("right"), F.col("last").alias("high"))
    joined = left.join(right, "begin").where("low < high")
    joined = materialize(joined.select(F.concat("left", F.array("high")).alias("items"), "left", "right"), "joined_sets")
    without = F.transform(F.sequence(F.lit(0), F.lit(size - 3)), lambda gone: F.filter("items", lambda _, at: at != gone))
    subsets = joined.select("items", F.explode(without).alias("subset"))
    held = subsets.join(frequent.select(F.col("items").alias("subset")), "subset", "left_semi")
    whole = held.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") == size - 2)
    return joined.join(whole.select("items"), "items")


def frequent_itemsets(edges: DataFrame, support: int, max_size: int) -> DataFrame:
    """``(size, items, freq)``: the sets of 1 to ``max_size`` communities that at least ``support`` (1 or more) authors have.

    ``edges`` are the distinct ones of :func:`author_edges`; ``items`` is sorted. Ends early when a level is empty.
    """
    if support < 1:
        raise ValueError("support is a number of authors, at least 1")
    edges = materialize(edges, "edges")
    items = materialize(item_counts(edges, support), "items")
    names = community_index(items, "item")
    listed = with_ordinals(prune(edges, items), names).select("author", "ord")
    edges = materialize(listed, "frequent_edges")
    found = [with_ordinals(items.withColumnRenamed("item", "subreddit"), names).select(F.array("ord").alias("items"), "freq")]
    if max_size > 1 and names.size > 1:
        counted = overlaps(edges, names.size, "author").where((F.col("i") < F.col("j")) & (F.col("common") >= support))
        level = materialize(counted.select(F.array("i", "j").alias("items"), F.col("common").alias("freq")), "sets")
        found.append(level)
        if max_size > 2:
            pairs = level.select("items", F.col("items")[0].alias("ord"), F.col("items")[1].alias("second"))
            second = edges.withColumnRenamed("ord", "second")
            holders = edges.join(small(pairs), "ord").join(second, ["author", "second"]).select("author", "items")
            for size in range(3, max_size + 1):
                if level.isEmpty():
                    break
                holders = materialize(holders, "holders")
                candidates = materialize(candidate_sets(level.select("items"), size), "candidates")
                first = holders.withColumnRenamed("items", "left").join(small(candidates), "left")
                both = first.join(holders.withColumnRenamed("items", "right"), ["author", "right"]).select("author", "items")
                held = materialize(both, "candidate_holders")
                level = materialize(held.groupBy("items").agg(F.count("*").alias("freq")).where(F.col("freq") >= support), "sets")
                holders = held.join(small(level.select("items")), "items", "left_semi")
                found.append(level)
    ordinals = found[0]
    for level in found[1:]:
        ordinals = ordinals.unionByName(level)
    stored = materialize(ordinals.withColumn("set", F.monotonically_increasing_id()), "itemsets")
    named = stored.select("set", "freq", F.explode("items").alias("ord")).join(names.bounded(names.frame), "ord")
    sets = named.groupBy("set", "freq").agg(F.sort_array(F.collect_list("community")).alias("items"))
    return sets.select(F.size("items").cast("long").alias("size"), "items", "freq")


def association_rules(pairs: DataFrame) -> DataFrame:
    """Both rules of each pair, ``antecedent`` to ``consequent``, with confidence freq(pair) / freq(antecedent)."""
    rules = F.array(
        F.struct(F.col("s1").alias("antecedent"), F.col("s2").alias("consequent"), (F.col("freq") / F.col("n1")).alias("confidence")),
        F.struct(F.col("s2").alias("antecedent"), F.col("s1").alias("consequent"), (F.col("freq") / F.col("n2")).alias("confidence")),
    )
    return pairs.select("freq", F.explode(rules).alias("rule")).select("rule.*", "freq")


def user_cosine(pairs: DataFrame) -> DataFrame:
    """User score of each pair: the root of the product of its two confidences, which is the cosine."""
    product = (F.col("freq") / F.col("n1")) * (F.col("freq") / F.col("n2"))
    return pairs.select("s1", "s2", F.sqrt(product).alias("score"))
