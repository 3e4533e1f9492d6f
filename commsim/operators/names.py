"""Common substrings of names, affix mining and affix tagging.

Only substrings that go on differently, to the right and to the left, in two places can be the longest common one of two
names. They come from the names' sorted suffixes (:mod:`commsim.operators.suffixes`), so a name has rows in proportion to its length.

Mining needs the longest common substring of every ordered pair of names, but only how often each
string is one. So names get dense ordinals and, as for overlaps, 64 share a bit mask: for each such substring
of a name, longest first, the mask of names that contain it minus the names settled by a longer one gives
the pairs it decides. No pair of names becomes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commsim.functions.strings import substrings
from commsim.operators.index import DenseIndex
from commsim.operators.pairs import TILE, community_index, directed_pairs, tile, tile_mask
from commsim.operators.suffixes import branching_substrings
from commsim.session import materialize, small

MIN_AFFIX = 4


def name_substrings(names: DataFrame, name: Column, *keys: str, min_length: int = 1) -> DataFrame:
    """``keys`` with ``start`` and ``sub`` of each substring of each name, for exact look-ups of short names."""
    parts = names.select(*keys, F.explode_outer(substrings(name, min_length)).alias("part"))
    return parts.where(F.col("part").isNotNull()).select(*keys, F.col("part.start").alias("start"), F.col("part.sub").alias("sub"))


def divergent(names: DataFrame, name: Column, min_length: int = 1) -> DataFrame:
    """``(ord, start, sub)``: the substrings that can be the longest common one of two names, written.

    If all places of a substring go on with the same character, on either side, the longer string stands at the same
    offsets in the same names and is preferred for every pair. Such a substring has no row, nor has one of a single name.
    """
    parts = branching_substrings(names, name, "ord", min_length=min_length)
    ends = parts.groupBy("sub").agg(
        (F.min("before") < F.max("before")).alias("left"), F.min("before").alias("first"), (F.min("ord") < F.max("ord")).alias("shared")
    )
    kept = ends.where("shared AND (left OR first = '')").select("sub")
    return materialize(parts.join(kept, "sub").select("ord", "start", "sub"), "substrings")


def common_substrings(names: DenseIndex, pairs: DataFrame | None = None) -> DataFrame:
    """``(i, j, lcs)``: the longest common substring of the names of ordinals ``i`` and ``j``.

    A substring of name ``i`` counts if it stands in name ``j`` at the same or a later offset. Ties go to the
    smallest shift, then to the smallest offset in ``i``. ``pairs`` are the requested ``(i, j)``, all by default; pairs
    without a common substring have no row.
    """
    parts = divergent(names.frame, F.col("community"))
    second = parts.select(F.col("ord").alias("i"), "start", "sub")
    wanted = directed_pairs(names).select("i", "j") if pairs is None else pairs.select("i", "j")
    first = wanted.join(parts.select(F.col("ord").alias("j"), F.col("start").alias("at"), "sub"), "j")
    best = F.struct(F.length("sub"), F.col("start") - F.col("at"), -F.col("start"))
    return first.join(second, ["i", "sub"]).where("at >= start").groupBy("i", "j").agg(F.max_by("sub", best).alias("lcs"))


def name_lcs(names: DenseIndex, pairs: DataFrame | None = None) -> DataFrame:
    """The longest common substring ``(s1, s2, lcs)`` of each requested pair ``(i, j, s1, s2)``, by default of each ordered pair of the list."""
    wanted = directed_pairs(names) if pairs is None else pairs
    common = common_substrings(names, wanted.select(F.col("j").alias("i"), F.col("i").alias("j")))
    turned = common.select(F.col("j").alias("i"), F.col("i").alias("j"), "lcs")
    return wanted.join(turned, ["i", "j"], "left").select("s1", "s2", F.coalesce("lcs", F.lit("")).alias("lcs"))


def affix_edges(names: DataFrame, affixes: DataFrame, name: str = "name", ignore_case: bool = False) -> DataFrame:
    """Distinct ``(name, affix)`` of the affixes a name contains.

    ``affixes`` is a written one-column table ``affix``. Names meet affixes by equality on their substrings.
    """
    text = F.lower(name) if ignore_case else F.col(name)
    listed = affixes.select((F.lower("affix") if ignore_case else F.col("affix")).alias("sub"), "affix")
    parts = name_substrings(names.select(name).distinct(), text, name).select(name, "sub").distinct()
    return parts.join(small(listed), "sub").select(name, "affix").distinct()


def lcs_counts(names: DenseIndex, name: Column, min_length: int = MIN_AFFIX) -> DataFrame:
    """How many ordered pairs of different names have ``lcs`` as their longest common substring.

    Counts strings of at least ``min_length``; see :func:`common_substrings` for the offset rule and ties.
    """
    parts = divergent(names.frame, name, min_length)
    holders = parts.groupBy("sub", F.col("start").alias("at"), tile(F.col("ord")).alias("tile")).agg(
        tile_mask(F.col("ord")).alias("mask")
    )
    own_bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("ord") % TILE).cast("int"))
    others = F.when(tile(F.col("ord")) == F.col("tile"), F.col("mask").bitwiseAND(F.bitwise_not(own_bit)))
    matches = (
        parts.join(holders, "sub")
        .where("at >= start")
        .select("ord", "tile", "start", "sub", (F.col("at") - F.col("start")).alias("shift"), F.coalesce(others, "mask").alias("mask"))
    )
    longest_first = Window.partitionBy("ord", "tile").orderBy(F.length("sub").desc(), "shift", "start")
    settled = F.coalesce(F.bit_or("mask").over(longest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    decided = matches.select("sub", F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not(settled))).alias("pairs"))
    return decided.where("pairs > 0").groupBy(F.col("sub").alias("lcs")).agg(F.sum("pairs").alias("pairs"))


def mine_affixes(names: DataFrame, name: str = "name", support: int = 0) -> DataFrame:
    """Affixes ``(affix, freq)`` of a list of names.

    Candidates are the common substrings of the lower-cased names. An affix is a candidate that is the
    common substring of more than ``support`` ordered pairs of candidates.
    """
    listed = community_index(names, name)
    first = materialize(lcs_counts(listed, F.lower("community")).select("lcs"), "candidates")
    candidates = community_index(first, "lcs")
    counts = lcs_counts(candidates, F.col("community"))
    kept = counts.join(first, "lcs", "left_semi").where(F.col("pairs") > support)
    return kept.select(F.col("lcs").alias("affix"), F.col("pairs").alias("freq"))


def tag_affixes(names: DataFrame, affixes: DataFrame, name: str = "name", ignore_case: bool = False) -> DataFrame:
    """``(name, affixes)``: the affixes of :func:`affix_edges`, sorted and ``|``-joined, empty if none."""
    distinct = names.select(name).distinct()
    found = affix_edges(distinct, affixes, name, ignore_case)
    joined = found.groupBy(name).agg(F.array_join(F.sort_array(F.collect_list("affix")), "|").alias("affixes"))
    return distinct.join(joined, name, "left").na.fill("", ["affixes"])
