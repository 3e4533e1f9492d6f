"""Benchmark decontamination by pigeonhole edit matching.

Texts become lower-case words. An item of ``m`` words may be found with up to ``k = floor(0.2 m)`` word edits. Cut into
``k + 1`` pieces, one of them must stand in the text unchanged: an automaton of all pieces finds these exact hits in one walk over
the text, and Myers' bit-parallel distance, an item word to a bit, verifies the text around each of them.

Items are a query set: they go to the tasks in blocks of at most :data:`BLOCK_BYTES`, and every text is searched for each
block. Nothing else leaves a task but the hits.

Defined results: null and empty texts contain nothing, and items without words are found nowhere; repeated rows give repeated
hits, repeated items each their own; a null id is carried along; empty tables give an empty result, and without items every
document stays. Whole texts are searched. :func:`drop_contaminated` keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDIT_SHARE = 0.2
BLOCK_BYTES = 4 << 20

WORDS = re.compile(r"\w+")
HITS = "array<struct<item_id:long,distance:int,start:int,stop:int>>"


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to any part of ``text``, and where the first such part ends."""
    m, equal = len(pattern), {}
    for i, word in enumerate(pattern):
        equal[word] = equal.get(word, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best, stop = m, 0
    for j, word in enumerate(text):
        eq = equal.get(word, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up, right_down = down | (~(diagonal | up) & full), up & diagonal
        if right_up & top:
            distance += 1
        elif right_down & top:
            distance -= 1
        right_up, right_down = (right_up << 1) & full, (right_down << 1) & full
        vertical = eq | down
        up, down = right_down | (~(vertical | right_up) & full), right_up & vertical
        if distance < best:
            best, stop = distance, j + 1
    return best, stop


def budget(n_words: int, share: float = EDIT_SHARE) -> int:
    return int(share * n_words + 1e-9)


@dataclass
class Matcher:
    """Finds items, given as ``(item_id, words)``, in texts."""

    items: list[tuple[int, list[str]]]
    share: float = EDIT_SHARE
    automaton: object = field(init=False)

    def __post_init__(self) -> None:
        import ahocorasick

        pieces: dict[str, list[tuple[int, int, int]]] = {}
        for i, (_, words) in enumerate(self.items):
            n = budget(len(words), self.share) + 1
            for p in range(n):
                lo, hi = len(words) * p // n, len(words) * (p + 1) // n
                pieces.setdefault(f" {' '.join(words[lo:hi])} ", []).append((i, lo, hi - lo))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, owners)
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item_id, distance, start, stop)`` of the best place of every item found; places count words."""
        words = words_of(text)
        if not words or not self.items:
            return []
        line = f" {' '.join(words)} "
        places: set[tuple[int, int]] = set()
        seen_end, seen_words = 0, 0
        for end, owners in self.automaton.iter(line):  # ends ascend, so words are counted once along the text
            seen_words += line.count(" ", seen_end, end)
            seen_end = end
            for item, offset, length in owners:
                places.add((item, seen_words - length - offset))
        best: dict[int, tuple[int, int, int]] = {}
        for item, at in sorted(places):
            pattern = self.items[item][1]
            k = budget(len(pattern), self.share)
            low = max(0, at - k)
            distance, stop = myers(pattern, words[low : max(0, at + len(pattern) + k)])
            if distance <= k and (item not in best or distance < best[item][0]):
                best[item] = (distance, max(low, low + stop - len(pattern)), low + stop)
        return [(self.items[i][0], *found) for i, found in best.items()]


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of bounded size, streamed through the driver one partition at a time."""
    block, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        words = words_of(row.text)
        if words:
            block.append((row.item_id, words))
            size += len(row.text)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def hits(text: Column, block: list[tuple[int, list[str]]], share: float = EDIT_SHARE) -> Column:
    """Array of ``(item_id, distance, start, stop)`` of the block's items found in a text."""
    held: list[Matcher] = []  # one per worker

    @F.pandas_udf(HITS)
    def found(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Matcher(block, share))
        keys = ("item_id", "distance", "start", "stop")
        return texts.map(lambda t: [dict(zip(keys, hit)) for hit in held[0].find(t)])

    return found(F.coalesce(text, F.lit("")))


def contamination(docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """One row ``(doc_id, item_id, distance, start, stop)`` for every item found in a document."""
    out = None
    for block in blocks(items):
        found = docs.select("doc_id", F.explode(hits(F.col("text"), block, share)).alias("hit")).select("doc_id", "hit.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        none = F.array().cast(HITS)
        return docs.select("doc_id", F.explode(none).alias("hit")).select("doc_id", "hit.*")
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """The documents in which no item is found."""
    for block in blocks(items):
        docs = docs.where(F.size(hits(F.col("text"), block, share)) == 0)
    return docs


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
