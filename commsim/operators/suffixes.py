"""Shared substrings of names from their sorted suffixes.

All suffixes of all names are sorted together, by ranges over all tasks. The common beginnings of a suffix with those
around it are the branching points of its path in the names' suffix tree: walking away from it to either side, each new
least common length is one. So a name of ``n`` characters has ``n`` rows plus one for each branching point, instead of
one for each of its substrings, and a substring that goes on alike in all its places never becomes a row.

A task keeps the lengths in two stacks, one for each direction. What crosses the border of two ranges is a stack, no
longer than the longest name: with each range's summary in hand the driver computes the stacks that enter every range, and a join
with this table of ranges completes the rows. No range is read twice, and a substring in very many names may span any number of ranges.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commsim.session import materialize

SWEPT = "part int, ord long, start int, before string, suffix string, depths array<int>, since int, till int, summary boolean, first string, last string"
FAR = 1 << 30


def sorted_suffixes(names: DataFrame, name: Column, *keys: str, min_length: int = 1) -> DataFrame:
    """``keys`` with ``start``, ``suffix`` and the character ``before`` it (empty at the start of a name) of every suffix of at
    least ``min_length`` characters, in order within and over partitions."""
    last = F.length("whole") - min_length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last))
    rows = names.select(*keys, name.alias("whole")).select(*keys, "whole", F.explode(starts).alias("start"))
    before = F.when(F.col("start") > 0, F.substr("whole", F.col("start"), F.lit(1))).otherwise("")
    suffixes = rows.select(*keys, "start", before.alias("before"), F.substr("whole", F.col("start") + 1).alias("suffix"))
    return suffixes.repartitionByRange("suffix", *keys, "start").sortWithinPartitions("suffix", *keys, "start")


def _sweep(min_length: int):
    def chains(lengths: list[int]) -> tuple[list[list[int]], list[int]]:
        """For each row the stack of least lengths towards the first row, and the least of all; ``lengths[k]`` is that of rows ``k - 1`` and ``k``."""
        stack: list[int] = []
        stacks, least = [[]], [FAR]
        for length in lengths[1:]:
            while stack and stack[-1] >= length:
                stack.pop()
            stack.append(length)
            stacks.append([d for d in stack if d >= min_length])
            least.append(min(least[-1], length))
        return stacks, least

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        data = pd.concat(rows, ignore_index=True)
        texts = data["suffix"].tolist()
        lengths = [0, *(len(os.path.commonprefix(pair)) for pair in zip(texts[:-1], texts[1:]))]
        before, since = chains(lengths)
        after, till = (x[::-1] for x in chains([0, *lengths[:0:-1]]))
        data["depths"] = [sorted({*a, *b}) for a, b in zip(before, after)]
        data["since"], data["till"], data["summary"], data["first"], data["last"] = since, till, False, None, None
        yield data
        # The summary: the whole stacks at both ends of the range, and the texts there.
        part = int(data["part"].iloc[0])
        for row, at_end in ((len(texts) - 1, True), (0, False)):
            whole = before[row] if at_end else after[row]
            least = since[row] if at_end else till[row]
            yield pd.DataFrame(
                [(part, 0, row, None, None, whole, least, int(at_end), True, texts[0], texts[-1])], columns=data.columns
            )

    return run


def entering_stacks(ends: list[tuple[int, list[int], int, str, str]], min_length: int) -> dict[int, list[int]]:
    """For ranges in walking order, ``(part, own stack at the far side, least inside, near text, far text)``, the stack that enters each."""
    found: dict[int, list[int]] = {}
    stack: set[int] = set()
    previous = None
    for part, own, least, near, far in ends:
        border = 0 if previous is None else len(os.path.commonprefix((previous, near)))
        entering = {min(d, border) for d in (*stack, border)}
        found[part] = sorted(d for d in entering if d >= min_length)
        stack = {*own, *(min(d, least) for d in found[part])}
        previous = far
    return found


def branching_substrings(names: DataFrame, name: Column, *keys: str, min_length: int = 1) -> DataFrame:
    """``keys`` with ``start``, ``sub`` and the character ``before`` it, of the substrings that stand elsewhere too and go on differently there.

    ``keys`` is one column of whole numbers that identifies the name. A substring stands elsewhere if it occurs twice, be it in one name.
    """
    (key,) = keys
    ordered = sorted_suffixes(names, name, key, min_length=min_length)
    placed = ordered.select(F.spark_partition_id().alias("part"), F.col(key).cast("long").alias("ord"), "start", "before", "suffix")
    swept = materialize(placed.mapInPandas(_sweep(min_length), SWEPT), "suffixes")
    summaries = swept.where("summary").collect()
    right = sorted((r.part, r.depths, r.since, r.first, r.last) for r in summaries if r.till)
    left = sorted(((r.part, r.depths, r.since, r.last, r.first) for r in summaries if not r.till), reverse=True)
    from_left, from_right = entering_stacks(right, min_length), entering_stacks(left, min_length)
    borders = [(part, from_left[part], from_right[part]) for part in from_left]
    entering = names.sparkSession.createDataFrame(borders, "part int, from_left array<int>, from_right array<int>")
    rows = swept.where("NOT summary").join(F.broadcast(entering), "part")
    crossing = F.concat(
        F.transform("from_left", lambda d: F.least(d, F.col("since"))), F.transform("from_right", lambda d: F.least(d, F.col("till")))
    )
    depths = F.array_distinct(F.concat("depths", F.filter(crossing, lambda d: d >= min_length)))
    parts = rows.select(F.col("ord").alias(key), "start", "before", "suffix", F.explode(depths).alias("depth"))
    return parts.select(key, "start", F.substr("suffix", F.lit(1), F.col("depth")).alias("sub"), "before")
