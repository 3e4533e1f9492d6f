"""Community metadata: mentions, moderators, their assembly, and the three directed similarities.

Moderators, mentions and affixes are edges ``(name, value)``. The similarities are equi-joins of edges that give a row for each
pair with a score above 0, keyed by the ordinals ``(i, j)`` of target and other in the list of names; they
are joined to the requested pairs at the end. ``|``-joined lists exist for the metadata file only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commsim.functions import strings as fn
from commsim.operators.index import DenseIndex
from commsim.operators.names import common_substrings, name_substrings
from commsim.operators.pairs import directed_pairs, with_ordinals
from commsim.session import materialize, small

MIN_SHARED_AFFIX = 4

# Shares of the three measures in the metadata score.
AFFIX_WEIGHT = 0.3
MENTION_WEIGHT = 0.6
MODERATOR_WEIGHT = 0.1


def mentions(texts: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """Distinct ``(name, mention)`` rows from wiki texts, without mentions of the community itself."""
    raw = texts.select(name, F.explode_outer(fn.mentions(F.col(text))).alias("raw")).where("raw is not null")
    own = F.contains(F.col("raw"), F.col(name)) | F.contains(F.col("raw"), F.lower(name))
    return raw.where(~own).select(name, fn.mention_name(F.col("raw")).alias("mention")).distinct()


def joined_lists(rows: DataFrame, name: str, value: str, joined: str) -> DataFrame:
    """``(name, joined)``: the distinct values of each name, sorted and ``|``-joined, for the metadata file.

    One line of the file holds a whole list, so this is for lists that one line can hold; repeats are
    removed before anything is collected.
    """
    distinct = rows.select(name, value).where(F.col(value).isNotNull()).distinct()
    return distinct.groupBy(name).agg(F.array_join(F.sort_array(F.collect_list(value)), "|").alias(joined))


def assemble(names: DataFrame, affixes: DataFrame, mods: DataFrame, mentioned: DataFrame) -> DataFrame:
    """One row ``(name, affixes, mods, mentions)`` per name; absent lists are empty strings."""
    joined = names.select("name")
    for lists in (affixes, mods, mentioned):
        joined = joined.join(lists, "name", "left")
    return joined.select("name", "affixes", "mods", "mentions").na.fill("")


def list_edges(metadata: DataFrame, joined: str, value: str) -> DataFrame:
    """``(name, value)`` edges of one list of metadata rows as the file holds them; an empty list has none."""
    parts = metadata.select("name", F.explode(fn.split_list(F.col(joined))).alias(value))
    return parts.where(F.col(value) != "").distinct()


def first_rows(metadata: DataFrame, count: int, place: str = "place") -> DataFrame:
    """The first ``count`` rows in file order, which the column ``place`` carries from 0 on."""
    return metadata.where(F.col(place) < count).drop(place)


def _whole_lists(edges: DataFrame, names: DenseIndex, value: str) -> DataFrame:
    """``(ord, value, n)`` of every listed name's values; a name without any has the empty value, as an empty list in the file."""
    named = with_ordinals(edges.select("name", value).where(F.col(value).isNotNull()).distinct(), names, "name")
    held = names.frame.select("ord").join(named.select("ord", value), "ord", "left").na.fill("", [value])
    held = materialize(held, "lists")
    return held.join(held.groupBy("ord").agg(F.count("*").alias("n")), "ord")


def moderator_scores(mods: DataFrame, names: DenseIndex, set_overlap: bool = False) -> DataFrame:
    """``(i, j, moderator)``: the share of the target's moderators that equal the other's whole list; with
    ``set_overlap``, that are among the other's moderators."""
    held = _whole_lists(mods, names, "mod")
    target = held.select(F.col("ord").alias("i"), "mod", "n")
    other = held if set_overlap else held.where("n = 1")
    shared = target.join(other.select(F.col("ord").alias("j"), "mod"), "mod").where("i <> j")
    return shared.groupBy("i", "j").agg((F.count("*") / F.first("n")).alias("moderator"))


def mention_scores(mentioned: DataFrame, names: DenseIndex, co_mention: bool = False) -> DataFrame:
    """``(i, j, mention)``: 1 if the target mentions the other's name in any case.

    By default a one-character mention that occurs in the other's mentions counts .5, and the last matching
    mention decides. With ``co_mention``, a common mention counts .5 if there is no direct one.
    """
    edges = with_ordinals(mentioned.where("mention IS NOT NULL AND mention <> ''"), names, "name")
    edges = materialize(edges.select("ord", "mention", F.lower("mention").alias("low")).distinct(), "mentions")
    target = edges.select(F.col("ord").alias("i"), "mention", "low")
    named = names.frame.select(F.col("ord").alias("j"), F.lower("community").alias("low"))
    direct = target.join(named, "low").select("i", "j", "mention", F.lit(1.0).alias("score"))
    if co_mention:
        others = edges.select(F.col("ord").alias("j"), "low").distinct()
        weak = target.select("i", "low").distinct().join(others, "low").select("i", "j", F.lit("").alias("mention"), F.lit(0.5).alias("score"))
        return direct.unionByName(weak).where("i <> j").groupBy("i", "j").agg(F.max("score").alias("mention"))
    signs = edges.select(F.col("ord").alias("j"), F.explode(F.array_distinct(F.split("low", ""))).alias("low")).distinct()
    single = target.where(F.length("low") == 1).join(signs, "low").select("i", "j", "mention", F.lit(0.5).alias("score"))
    last = F.max_by("score", F.struct("mention", "score"))
    return direct.unionByName(single).where("i <> j").groupBy("i", "j").agg(last.alias("mention"))


def affix_scores(
    affixes: DataFrame, names: DenseIndex, words: DataFrame, any_affix: bool = False, pairs: DataFrame | None = None
) -> DataFrame:
    """``(i, j, affix)``: 1 if the other name contains the target's last affix, .5 if the names' common substring is a word.

    With ``any_affix`` every affix of the target counts. ``affixes`` are edges ``(name, affix)``, ``words`` is a
    written one-column table ``word`` of distinct words. ``pairs`` are the requested ``(i, j)``, all of the list by default; they
    come before every look-up, so a word or an affix in very many names gives rows for requested pairs alone.
    """
    wanted = (directed_pairs(names) if pairs is None else pairs).select("i", "j")
    own = with_ordinals(affixes.select("name", "affix"), names, "name").select(F.col("ord").alias("i"), F.col("affix").alias("sub"))
    deciding = own.distinct() if any_affix else own.groupBy("i").agg(F.max("sub").alias("sub"))
    parts = name_substrings(names.frame, F.col("community"), "ord").select("ord", "sub").distinct()
    words = small(words)
    held = parts.select(F.col("ord").alias("j"), "sub")
    long = deciding.where(F.length("sub") >= MIN_SHARED_AFFIX)
    hits = wanted.join(long, "i").join(held, ["j", "sub"]).select("i", "j").distinct().withColumn("score", F.lit(1.0))
    # Only pairs that share a word at all can have a word as their longest common substring.
    worded = parts.join(words.withColumnRenamed("word", "sub"), "sub")
    sharing = wanted.join(worded.withColumnRenamed("ord", "i"), "i").join(worded.withColumnRenamed("ord", "j"), ["j", "sub"])
    candidates = materialize(sharing.select("i", "j").distinct(), "candidates")
    common = common_substrings(names, candidates)
    known = common.join(words.withColumnRenamed("word", "lcs"), "lcs").select("i", "j", F.lit(0.5).alias("score"))
    return hits.unionByName(known).groupBy("i", "j").agg(F.max("score").alias("affix"))


def on_pairs(names: DenseIndex, *scores: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The requested ordered pairs ``(i, j, s1, s2)``, all of the list by default, with the sparse scores; absent ones are 0."""
    out = directed_pairs(names) if pairs is None else pairs
    for score in scores:
        out = out.join(score, ["i", "j"], "left")
    return out.na.fill(0.0)


def meta_scores(
    affixes: DataFrame,
    mods: DataFrame,
    mentioned: DataFrame,
    names: DenseIndex,
    words: DataFrame,
    any_affix: bool = False,
    set_overlap: bool = False,
    co_mention: bool = False,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Directed score of each requested pair: ``(i, j, s1, s2, affix, mention, moderator, score)``."""
    scored = on_pairs(
        names,
        affix_scores(affixes, names, words, any_affix, pairs),
        mention_scores(mentioned, names, co_mention),
        moderator_scores(mods, names, set_overlap),
        pairs=pairs,
    )
    total = F.col("affix") * AFFIX_WEIGHT + F.col("mention") * MENTION_WEIGHT + F.col("moderator") * MODERATOR_WEIGHT
    return scored.select("i", "j", "s1", "s2", "affix", "mention", "moderator", total.alias("score"))
