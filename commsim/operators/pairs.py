"""Pairs of communities: spines, overlap counts, Jaccard and set operations.

A report over a given list has one row per pair of the *listed* communities, so the list bounds its size; without
a list, :func:`sharing_jaccard` reports the pairs that share something.
Overlaps are counted for all pairs in one job. Communities get dense ordinals, 64 of which share a tile,
and every feature is reduced to one 64-bit mask per tile. A feature with any number of rows is thereby at
most one small row per tile after map-side combining. Features with equal masks then merge into one
weighted row, and only these rows, never the members of a feature's group, are unfolded to pair counts.
With more tiles, features with equal members merge, their sorted members are dealt to blocks of communities, and a block's pairs are
unfolded and counted in arrays where its rows meet, so that counts are shuffled and not the pairs of every feature. Features that an
eighth of all communities hold are turned around: 64 of them become the bits of one word for each community, and the words of two tiles
give all their pairs' counts at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commsim.operators.index import DenseIndex, dense_index, number_rows
from commsim.session import materialize, small

TILE = 64
PAIRS_PER_TASK = 4_000_000
HEAVY_TILES = 8
DENSE = 8  # 64 features held by one community in so many cost as much as bits of words as their pairs do
MEAN_PAIRS = 4_000_000
BLOCK_PAIRS = 9_000_000
MAX_TASKS = 10_000
GROUP = 8  # divides TILE


def community_index(names: DataFrame, name: str = "subreddit", order: str | None = None) -> DenseIndex:
    """Dense ordinals of the listed communities, as columns ``community`` and ``ord``.

    Distinct names are numbered alphabetically; with ``order``, a column of list places, each name is
    numbered by its first place.
    """
    listed = names.where(F.col(name).isNotNull())
    if order is None:
        return dense_index(listed.select(F.col(name).alias("community")), "community", "ord")
    placed = listed.groupBy(F.col(name).alias("community")).agg(F.min(order).alias("place_in_list"))
    numbered = number_rows(placed, "place_in_list", "ord")
    return DenseIndex(numbered.frame.select("community", "ord"), numbered.size)


def with_ordinals(df: DataFrame, communities: DenseIndex, community: str = "subreddit") -> DataFrame:
    """Rows of listed communities, with the community's ``ord``."""
    return df.join(communities.bounded(communities.frame.withColumnRenamed("community", community)), community)


def _partners(communities: DenseIndex, first: Column) -> DataFrame:
    """``(community, ord, other)`` with ``other`` running over the ordinals in the array ``first``."""
    tasks = communities.size**2 // PAIRS_PER_TASK + 1
    left = communities.frame.repartition(tasks, "ord") if tasks > 1 else communities.frame
    return left.select("community", "ord", F.explode(first).alias("other"))


def pair_spine(communities: DenseIndex) -> DataFrame:
    """All unordered pairs in list order: ``(i, j, s1, s2)`` with ``i < j``."""
    later = F.when(
        F.col("ord") < communities.size - 1, F.sequence(F.col("ord") + 1, F.lit(communities.size - 1).cast("long"))
    )
    left = _partners(communities, later).select(F.col("community").alias("s1"), F.col("ord").alias("i"), F.col("other").alias("j"))
    right = communities.frame.select(F.col("community").alias("s2"), F.col("ord").alias("j"))
    return left.join(communities.bounded(right), "j").select("i", "j", "s1", "s2")


def directed_pairs(communities: DenseIndex) -> DataFrame:
    """All ordered pairs of different communities: ``(i, j, s1, s2)``."""
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(communities.size - 1).cast("long")), lambda o: o != F.col("ord"))
    left = _partners(communities, others).select(F.col("community").alias("s1"), F.col("ord").alias("i"), F.col("other").alias("j"))
    right = communities.frame.select(F.col("community").alias("s2"), F.col("ord").alias("j"))
    return left.join(communities.bounded(right), "j").select("i", "j", "s1", "s2")


def tile(ordinal: Column) -> Column:
    return F.floor(ordinal / TILE).cast("int")


def tile_mask(ordinal: Column) -> Column:
    """Aggregate: the ordinals of one tile as a bit mask. Repeats do not matter."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (ordinal % TILE).cast("int")))


def ordinals(part: Column) -> Column:
    """Array of the ordinals in a ``{tile, mask}`` struct."""
    first = part["tile"].cast("long") * TILE
    bits = F.filter(F.sequence(F.lit(0), F.lit(TILE - 1)), lambda b: F.getbit(part["mask"], b) == 1)
    only = F.when(part["mask"] < 0, TILE - 1).otherwise(F.bit_count(part["mask"] - 1))  # of a single bit, its place
    return F.when(F.bit_count(part["mask"]) == 1, F.array(first + only)).otherwise(F.transform(bits, lambda b: first + b))


def _tile_masks(edges: DataFrame, feature: str) -> DataFrame:
    return (
        edges.where(F.col(feature).isNotNull())
        .groupBy(feature, tile(F.col("ord")).alias("tile"))
        .agg(tile_mask(F.col("ord")).alias("mask"))
    )


def _collected(masks: DataFrame, feature: str) -> DataFrame:
    return masks.groupBy(feature).agg(F.sort_array(F.collect_list(F.struct("tile", "mask"))).alias("parts"))


def memberships(edges: DataFrame, size: int, feature: str) -> DataFrame:
    """Each feature with its communities as an array of ``{tile, mask}`` structs, one per tile: ``(feature, parts)``.

    ``edges`` has ``ord`` (see :func:`with_ordinals`) and ``feature``, with or without repeats. ``size``
    is the number of communities.
    """
    if size <= TILE:
        masks = edges.where(F.col(feature).isNotNull()).groupBy(feature).agg(tile_mask(F.col("ord")).alias("mask"))
        return masks.select(feature, F.array(F.struct(F.lit(0).alias("tile"), "mask")).alias("parts"))
    return _collected(_tile_masks(edges, feature), feature)


def member_rows(features: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``ord`` of every member of every feature, the distinct edges of :func:`memberships`."""
    parts = features.select(*keys, F.explode_outer("parts").alias("part"))
    return parts.select(*keys, F.explode_outer(ordinals(F.col("part"))).alias("ord"))


def overlaps(edges: DataFrame, size: int, feature: str, heavy_tiles: int = HEAVY_TILES, among: DataFrame | None = None) -> DataFrame:
    """Numbers of shared features ``(i, j, common)`` for all ``i <= j`` that share one; ``i = j`` is a community's own number.

    Arguments as for :func:`memberships`. With more than ``heavy_tiles`` tiles of communities, features are counted by
    :func:`block_overlaps`, or by :func:`heavy_overlaps` if they are in more than ``heavy_tiles`` tiles and held by one community in
    :data:`DENSE`; the bounds choose between ways and do not change results. ``among`` is a written table ``(g, h)`` of pairs of groups
    of :data:`GROUP` ordinals; pairs in others are left out before they are shuffled.
    """
    if size <= TILE:
        weighted = memberships(edges, size, feature).groupBy("parts").agg(F.count("*").alias("weight"))
        blocks = weighted.select(F.col("parts")[0].alias("a"), F.col("parts")[0].alias("b"), "weight")
        return _unfolded(blocks, among=among)
    if size <= TILE * heavy_tiles:
        return _unfolded(_tile_blocks(memberships(edges, size, feature), among), among=among)
    sets = materialize(member_sets(edges, feature), "features")
    dense = (F.size("members") * DENSE > size) & (F.size(F.array_distinct(F.transform("members", tile))) > heavy_tiles)
    cells, parted = block_overlaps(sets.where(~dense), size, among)
    copies = sets.where(dense).select("members", "set", F.explode(F.sequence(F.lit(1).cast("long"), "weight")).alias("copy"))
    heavy = number_rows(copies.select("members", F.struct("set", "copy").alias("by")), "by", "number")
    if heavy.size:
        members = heavy.frame.select("number", F.explode(F.col("members").cast("array<long>")).alias("ord"))
        cells, parted = cells.unionByName(_among(heavy_overlaps(members, size), among)), True
    return cells.groupBy("i", "j").agg(F.sum("weight").alias("common")) if parted else cells.withColumnRenamed("weight", "common")


def member_sets(edges: DataFrame, feature: str) -> DataFrame:
    """The different sets of communities that hold a feature: ``(members, weight, set)``.

    ``members`` are sorted ordinals, ``weight`` the number of features with just these, and ``set`` an id, which holds once it is written.
    Repeats combine before the one shuffle of edges.
    """
    held = edges.where(F.col(feature).isNotNull()).groupBy(feature).agg(F.collect_set(F.col("ord").cast("int")).alias("members"))
    merged = held.select(F.sort_array("members").alias("members")).groupBy("members").agg(F.count("*").alias("weight"))
    return merged.withColumn("set", F.monotonically_increasing_id())


def block_overlaps(sets: DataFrame, size: int, among: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Shares ``(i, j, weight)``, ``i <= j``, of what communities have in common in written :func:`member_sets`, and whether a pair may have several.

    Neighbouring communities make a block of about :data:`MEAN_PAIRS` pairs. A set sends each block with members of it one row, its
    members from there on, and the rows of a block meet in one task. A block of more than :data:`BLOCK_PAIRS` pairs is dealt out in
    shares, whose counts have to be summed.
    """
    at = sets.select("members", "weight", F.posexplode("members").alias("at", "first"))
    pairs = F.sum((F.size("members") - F.col("at")).cast("long"))
    loads = at.groupBy(tile(F.col("first")).alias("tile")).agg(pairs.alias("pairs")).collect()  # at most one row per tile
    every = -(-size // TILE)
    tiles = min(every, every * MEAN_PAIRS // max(1, sum(r.pairs for r in loads)) + 1)
    blocks: dict[int, int] = {}
    for r in loads:
        blocks[r.tile // tiles] = blocks.get(r.tile // tiles, 0) + r.pairs
    dealt = [(block, pairs // BLOCK_PAIRS + 1) for block, pairs in blocks.items()]
    tasks = min(MAX_TASKS, max(1, sum(shares for _, shares in dealt)))
    width = tiles * TILE
    block, before = (F.floor(first / width).cast("int") for first in (F.col("first"), F.get("members", F.col("at") - 1)))
    begun = at.where((F.col("at") == 0) | (block > before))
    rows = begun.select(block.alias("block"), F.slice("members", F.col("at") + 1, F.size("members")).alias("members"), "weight")
    shares = sets.sparkSession.createDataFrame(dealt, "block int, shares long")
    share = F.pmod(F.xxhash64("members"), F.col("shares"))
    met = rows.join(F.broadcast(shares), "block").select("block", share.alias("share"), "members", "weight").repartition(tasks, "block", "share")
    counted = met.groupBy("block", "share").applyInArrow(_counted(width, size), "i int, j int, weight long")
    cells = counted.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "weight")
    return _among(cells, among), any(shares > 1 for _, shares in dealt)


def _counted(width: int, size: int):
    """For the rows of one block, the weights of the pairs of its members with all members not before them.

    A pair is one number, and equal numbers are counted by sorting at most about :data:`PAIRS_PER_TASK` at a time.
    """
    number, limit = np.uint32 if width * size <= 1 << 32 else np.int64, PAIRS_PER_TASK

    def summed(keys, weights):
        if weights is None:
            keys.sort()
        else:
            order = np.argsort(keys, kind="stable")
            keys, weights = keys[order], weights[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[starts], np.diff(starts, append=len(keys)) if weights is None else np.add.reduceat(weights, starts)

    def run(table: pa.Table) -> pa.Table:
        base = table.column("block")[0].as_py() * width
        lists = table.column("members").combine_chunks()
        lengths, members = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        at = np.flatnonzero(members < base + width).astype(np.int32)
        row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[at]
        later, weights = np.cumsum(lengths, dtype=np.int32)[row] - at, table.column("weight").to_numpy()
        total, found, begin = np.cumsum(later, dtype=np.int64), [], 0
        while begin < len(at):
            done = total[begin] - later[begin]
            end = max(begin + 1, int(np.searchsorted(total, done + limit, "right")))
            n, w, own = later[begin:end], weights[row[begin:end]], at[begin:end]
            second = np.arange(total[end - 1] - done) + np.repeat(own - (total[begin:end] - n - done), n)
            keys = np.repeat((members[own] - base).astype(number) * number(size), n) + members[second].astype(number)
            found.append(summed(keys, None if (w == 1).all() else np.repeat(w, n)))
            begin = end
        keys, weights = found[0] if len(found) == 1 else summed(*(np.concatenate(x) for x in zip(*found)))
        first, second = np.divmod(keys, number(size))
        return pa.table({"i": (first + number(base)).astype(np.int32), "j": second.astype(np.int32), "weight": weights.astype(np.int64)})

    return run


def supported_overlaps(edges: DataFrame, feature: str, support: float) -> DataFrame:
    """:func:`overlaps` of at least ``support``, found in two passes.

    Communities are numbered anew by their own number, so that a group of :data:`GROUP` neighbours is about equally large. The first
    pass counts the features that two groups share, each once; no pair of their communities shares more. The second counts exactly
    the pairs in groups that share ``support``.
    """
    edges = materialize(edges.where(F.col(feature).isNotNull()).select("ord", feature).distinct(), "edges")
    own = materialize(edges.groupBy("ord").agg(F.count("*").alias("n")).where(F.col("n") >= support), "own")
    ranks = number_rows(own.select(F.struct("n", "ord").alias("by")), "by", "rank")
    ranked = ranks.frame.select("by.ord", "rank")
    kept = materialize(edges.join(ranks.bounded(ranked), "ord").select(F.col("rank").alias("ord"), feature), "ranked_edges")
    grouped = kept.select(_group("ord").alias("ord"), feature)
    shared = overlaps(grouped, -(-ranks.size // GROUP), feature).where(F.col("common") >= support)
    among = materialize(shared.select(F.col("i").alias("g"), F.col("j").alias("h")), "groups")
    exact = overlaps(kept, ranks.size, feature, among=among).where(F.col("common") >= support)
    for rank, ordinal in (("i", "x"), ("j", "y")):
        named = ranked.select(F.col("rank").alias(rank), F.col("ord").alias(ordinal))
        exact = exact.join(ranks.bounded(named), rank)
    return exact.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "common")


def _group(ordinal) -> Column:
    return F.floor(F.col(ordinal) / GROUP)


def _among(cells: DataFrame, among: DataFrame | None) -> DataFrame:
    if among is None:
        return cells
    found = cells.select("*", _group("i").alias("g"), _group("j").alias("h")).join(small(among), ["g", "h"], "left_semi")
    return found.drop("g", "h")


def _tile_blocks(features: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """The weighted pairs ``(a, b, weight)`` of tiles, ``a`` not after ``b``, of features with ``parts``; ``among`` as for :func:`overlaps`."""
    weighted = features.groupBy("parts").agg(F.count("*").alias("weight"))
    firsts = weighted.select(F.explode_outer("parts").alias("a"), "parts", "weight")
    later = F.filter("parts", lambda p: p["tile"] >= F.col("a.tile"))
    blocks = firsts.select("a", F.explode_outer(later).alias("b"), "weight")
    if among is not None:
        first, second = (F.floor(F.col(g) * GROUP / TILE).cast("int") for g in ("g", "h"))
        tiles = materialize(among.select(first.alias("s"), second.alias("t")).distinct(), "tiles")
        blocks = blocks.select("*", F.col("a.tile").alias("s"), F.col("b.tile").alias("t")).join(small(tiles), ["s", "t"], "left_semi")
    return blocks.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def _unfolded(blocks: DataFrame, among: DataFrame | None = None) -> DataFrame:
    members = blocks.select(ordinals(F.col("a")).alias("in_a"), ordinals(F.col("b")).alias("in_b"), "weight")
    rows = members.select(F.explode_outer("in_a").alias("i"), "in_b", "weight")
    cells = _among(rows.select("i", F.explode_outer("in_b").alias("j"), "weight").where("i <= j"), among)
    return cells.groupBy("i", "j").agg(F.sum("weight").alias("common"))


def heavy_overlaps(members: DataFrame, size: int) -> DataFrame:
    """Shares ``(i, j, weight)``, ``i <= j``, of what communities have in common among numbered features: ``members`` has ``(number, ord)``.

    64 features are the bits of one word for each community, and the 64 words of a tile are one row. A row meets those of the
    tiles not before it, one by one, and each meeting gives the pairs of two tiles by counting the bits of their words' intersections.
    """
    tiles = -(-size // TILE)
    chunk, bit = F.floor(F.col("number") / TILE), (F.col("number") % TILE).cast("int")
    words = members.groupBy(chunk.alias("chunk"), "ord").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("word"))
    rows = words.groupBy("chunk", tile(F.col("ord")).alias("tile")).agg(F.collect_list(F.struct("ord", "word")).alias("words"))
    rows = materialize(rows, "words")
    first = rows.select("chunk", F.col("words").alias("a"), F.explode(F.sequence("tile", F.lit(tiles - 1))).alias("tile"))
    met = first.join(rows.withColumnRenamed("words", "b"), ["chunk", "tile"])
    left = met.select(F.explode("a").alias("x"), "b")
    common = left.select(F.col("x.ord").alias("i"), F.explode(F.transform("b", lambda y: F.struct(y["ord"].alias("j"), F.bit_count(y["word"].bitwiseAND(F.col("x.word"))).cast("long").alias("weight")))).alias("y"))
    cells = common.select("i", "y.j", "y.weight").where("i <= j AND weight > 0")
    return cells.groupBy("i", "j").agg(F.sum("weight").alias("weight"))


def pair_overlaps(edges: DataFrame, communities: DenseIndex, feature: str, community: str = "subreddit", support: float = 0.0) -> DataFrame:
    """:func:`overlaps` of all listed communities, written because sizes and pairs are both read from it.

    Above 1, ``support`` leaves out smaller overlaps by :func:`supported_overlaps`.
    """
    placed = with_ordinals(edges, communities, community)
    if support > 1:
        return materialize(supported_overlaps(placed, feature, support), "overlaps")
    return materialize(overlaps(placed, communities.size, feature), "overlaps")


def _own_counts(counts: DataFrame, communities: DenseIndex, ordinal: str, n: str) -> DataFrame:
    return communities.bounded(counts.where("i = j").select(F.col("i").alias(ordinal), F.col("common").alias(n)))


def jaccard(counts: DataFrame, communities: DenseIndex) -> DataFrame:
    """Jaccard of every pair of a given list, including pairs that share nothing: ``(i, j, s1, s2, n1, n2, common, jaccard)``.

    ``counts`` comes from :func:`pair_overlaps`. Two communities without features have no score.
    """
    joined = _with_sizes(pair_spine(communities).join(counts.where("i < j"), ["i", "j"], "left"), counts, communities)
    return _jaccard_of(joined)


def sharing_jaccard(counts: DataFrame, communities: DenseIndex) -> DataFrame:
    """Like :func:`jaccard` for the pairs that share something, which bounds the rows when no list is given."""
    own = counts.where("i = j").select(F.col("i").alias("ord"), F.col("common").alias("n"))
    known = materialize(communities.frame.join(communities.bounded(own), "ord", "left").na.fill(0, ["n"]), "sizes")
    named = counts.where("i < j")
    for ordinal, name, n in (("i", "s1", "n1"), ("j", "s2", "n2")):
        side = known.select(F.col("ord").alias(ordinal), F.col("community").alias(name), F.col("n").alias(n))
        named = named.join(communities.bounded(side), ordinal)
    return _jaccard_of(named)


def _with_sizes(pairs: DataFrame, counts: DataFrame, communities: DenseIndex) -> DataFrame:
    return (
        pairs
        .join(_own_counts(counts, communities, "i", "n1"), "i", "left")
        .join(_own_counts(counts, communities, "j", "n2"), "j", "left")
        .na.fill(0, ["common", "n1", "n2"])
    )


def _jaccard_of(joined: DataFrame) -> DataFrame:
    union = F.col("n1") + F.col("n2") - F.col("common")
    return joined.select(
        "i", "j", "s1", "s2", "n1", "n2", "common", F.when(union > 0, F.col("common") / union).alias("jaccard")
    )


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of both, nulls being equal; repeats combine before the one shuffle."""
    sides = a.withColumn("side_", F.lit(1)).union(b.withColumn("side_", F.lit(2)))
    return sides.groupBy(*a.columns).agg(F.bit_or("side_").alias("side_")).where("side_ = 3").drop("side_")
