"""Periodic runs of words, by constant-time longest common extensions in suffix trees.

A run is a longest stretch of words in which words ``period`` apart are equal. Every run of two periods or more holds its
Lyndon root, and there the root is the longest Lyndon word that starts at its place, for the order of words or for the
opposite one. That word ends at the next smaller suffix, so each place gives one candidate root an order. A candidate is
extended in both directions: to the right by the longest common extension in the suffix tree of the words, to the left by
that in the tree of their reversal. Trees are built by Ukkonen's method; extensions are range minima over Euler tours.

Trees are not built over words that no run can hold. A run of at least four periods holds each of its words at least four
times, so a word that occurs less often in its stretch ends the stretch on both sides, until every word left occurs four
times in its own. This loses no run, because a run's words are never taken from it.

Each document is worked on by itself, so nothing is shuffled. Memory grows with the longest stretch that is left, by
some 500 bytes a word; a text without repetition costs a few bytes a word.

Defined results: null and empty texts have no words, no run and an empty rest; rows with a null id are read like others;
repeated rows give repeated results; an empty table gives an empty result. Whole texts are read. All columns of the
input stay, and the added ones get names that the input does not have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commsim.llm.columns import spare

LEAST_LENGTH = 6
LEAST_PERIODS = 4
GROUP_CHARS = 1 << 22
BLOCK = 32

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
        ),
        T.StructField("collapsed", T.StringType()),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """Words between the ASCII white space signs."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class SuffixTree:
    """The suffix tree of symbols above 0, closed by the symbol 0, ready for longest common extensions.

    ``order`` has the suffixes in the order of symbols, ``opposite`` in the opposite order; in both a suffix comes after
    its own beginnings.
    """

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        sigma = max(text) + 1
        self.size = len(text)
        start, end, child = self._grow(text, sigma)
        self._lay_out(np.array(start), np.array(end), child, sigma)

    @staticmethod
    def _grow(text: list[int], sigma: int) -> tuple[list[int], list[int], dict[int, int]]:
        """Ukkonen's construction: edges as spans of the text, children by node and first symbol."""
        n = len(text)
        start, end, link, child = [0], [0], [0], {}
        node = edge = length = waiting = 0
        for i, symbol in enumerate(text):
            waiting += 1
            split = 0
            while waiting:
                if not length:
                    edge = i
                key = node * sigma + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if split:
                        link[split] = node
                        split = 0
                else:
                    first = start[below]
                    span = min(end[below], i + 1) - first
                    if length >= span:
                        node = below
                        edge += span
                        length -= span
                        continue
                    if text[first + length] == symbol:
                        length += 1
                        if split:
                            link[split] = node
                        break
                    inner = len(start)
                    child[key] = inner
                    child[inner * sigma + symbol] = inner + 1
                    child[inner * sigma + text[first + length]] = below
                    start += (first, i)
                    end += (first + length, n)
                    link += (0, 0)
                    start[below] = first + length
                    if split:
                        link[split] = inner
                    split = inner
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        return start, end, child

    def _lay_out(self, start: np.ndarray, end: np.ndarray, child: dict[int, int], sigma: int) -> None:
        keys = np.fromiter(child.keys(), np.int64, len(child))
        below = np.fromiter(child.values(), np.int64, len(child))
        sorted_keys = np.argsort(keys)
        kids, owners = below[sorted_keys], keys[sorted_keys] // sigma
        closing = keys[sorted_keys] % sigma == 0
        at = np.searchsorted(owners, np.arange(len(start) + 1))
        self._tour(kids.tolist(), at.tolist(), (end - start).tolist())
        self._order(kids.tolist(), at.tolist(), closing.tolist())

    def _tour(self, kids: list[int], at: list[int], spans: list[int]) -> None:
        """The Euler tour: string depths in visiting order, and each suffix's first place in it."""
        nodes = len(spans)
        up, depth, place = [0] * nodes, [0] * nodes, [0] * nodes
        depths, following, node = [0], at[:], 0
        while True:
            k = following[node]
            if k < at[node + 1]:
                following[node] = k + 1
                kid = kids[k]
                up[kid] = node
                depth[kid] = reached = depth[node] + spans[kid]
                place[kid] = len(depths)
                depths.append(reached)
                node = kid
            elif node:
                node = up[node]
                depths.append(depth[node])
            else:
                break
        self.depth = np.array(depth)
        leaves = np.nonzero(np.diff(np.array(at)) == 0)[0]
        self.place = np.empty(self.size, np.int64)
        self.place[self.size - self.depth[leaves]] = np.array(place)[leaves]
        self._prepare_minima(np.array(depths, np.int32))

    def _order(self, kids: list[int], at: list[int], closing: list[bool]) -> None:
        size, depth = self.size, self.depth.tolist()
        self.order, self.opposite = [], []
        for found, opposite in ((self.order, False), (self.opposite, True)):
            stack = [0]
            while stack:
                node = stack.pop()
                lo, hi = at[node], at[node + 1]
                if lo == hi:
                    found.append(size - depth[node])
                elif not opposite:
                    stack += kids[lo:hi][::-1]
                elif closing[lo]:
                    stack += kids[lo + 1 : hi]
                    stack.append(kids[lo])
                else:
                    stack += kids[lo:hi]

    def _prepare_minima(self, depths: np.ndarray) -> None:
        """Range minima in constant time: minima towards both ends of each block, and a sparse table over blocks."""
        blocks = -(-len(depths) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(depths)] = depths
        grid = padded.reshape(blocks, BLOCK)
        self.depths = padded
        self.from_start = np.minimum.accumulate(grid, axis=1).ravel()
        self.to_end = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= blocks:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lengths of the longest common beginnings of the suffixes ``a`` and ``b``, which differ."""
        left, right = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b])
        first, last = left // BLOCK, right // BLOCK
        found = np.minimum(self.to_end[left], self.from_start[right])
        between = last - first - 1
        for k, level in enumerate(self.levels):
            here = (between >= 1 << k) & (between < 2 << k)
            if here.any():
                low, high = first[here] + 1, last[here] - (1 << k)
                found[here] = np.minimum(found[here], np.minimum(level[low], level[high]))
        inside = np.nonzero(first == last)[0]
        if len(inside):
            at = left[inside, None] + np.arange(BLOCK)
            seen = self.depths[np.minimum(at, len(self.depths) - 1)]
            found[inside] = np.where(at <= right[inside, None], seen, np.iinfo(np.int32).max).min(axis=1)
        return found.astype(np.int64)


def next_smaller(order: list[int]) -> np.ndarray:
    """For each suffix the next one, by place, that comes before it in ``order``."""
    size = len(order)
    rank = [0] * size
    for r, suffix in enumerate(order):
        rank[suffix] = r
    found, stack = [0] * size, []
    for i in range(size - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        found[i] = stack[-1] if stack else size
        stack.append(i)
    return np.array(found)


def stretch_runs(symbols: np.ndarray, least_length: int, least_periods: int) -> np.ndarray:
    """The runs ``(start, length, period)`` of a stretch of symbols, sorted by start and period."""
    n = len(symbols)
    listed = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    tree, mirrored = SuffixTree(listed), SuffixTree(listed[::-1])
    places = np.arange(n)
    starts, ends = [], []
    for order in (tree.order, tree.opposite):
        following = next_smaller(order)[:n]
        fits = (following < n) & ((following - places) * least_periods <= n)
        starts.append(places[fits])
        ends.append(following[fits])
    a, b = np.concatenate(starts), np.concatenate(ends)
    right = tree.extension(a, b)
    left = np.zeros(len(a), np.int64)
    inner = a > 0
    left[inner] = mirrored.extension(n - a[inner], n - b[inner])
    period = b - a
    length = left + period + right
    kept = length >= np.maximum(least_length, least_periods * period)
    found = np.stack((a - left, length, period), axis=1)[kept]
    return np.unique(found, axis=0)[:, [0, 1, 2]] if len(found) else found


def stretches(symbols: np.ndarray, owners: np.ndarray, least_length: int, least_periods: int) -> list[tuple[int, int]]:
    """The spans of one owner's symbols in which each symbol occurs ``least_periods`` times, of ``least_length`` or more.

    Together they hold every run of that length and as many periods.
    """
    at = np.arange(len(symbols))
    group = owners
    width = int(symbols.max(initial=0)) + 1
    while True:
        before = len(at)
        _, which, counts = np.unique(group * width + symbols[at], return_inverse=True, return_counts=True)
        kept = counts[which] >= least_periods
        at, group = at[kept], group[kept]
        if not len(at):
            return []
        cut = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(group) != 0)))
        piece = np.cumsum(cut) - 1
        long = np.bincount(piece)[piece] >= least_length
        at, group = at[long], piece[long]
        if len(at) == before or not len(at):
            break
    if not len(at):
        return []
    edges = np.concatenate(([0], np.nonzero(np.diff(group))[0] + 1, [len(at)])).tolist()
    return [(int(at[lo]), int(at[hi - 1]) + 1) for lo, hi in zip(edges[:-1], edges[1:])]


def runs_of_all(
    texts: list[list[bytes]], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS
) -> list[np.ndarray]:
    """The runs ``(start, length, period)`` of each list of words, by start and period."""
    numbers: dict[bytes, int] = {}
    sizes = [len(t) for t in texts]
    symbols = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, sum(sizes))
    owners = np.repeat(np.arange(len(texts)), sizes)
    begins = np.concatenate(([0], np.cumsum(sizes)))
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for lo, hi in stretches(symbols, owners, least_length, least_periods):
        runs = stretch_runs(symbols[lo:hi], least_length, least_periods)
        if len(runs):
            owner = int(owners[lo])
            found[owner].append(runs + np.array([lo - begins[owner], 0, 0]))
    none = np.empty((0, 3), np.int64)
    merged = [np.concatenate(r) if r else none for r in found]
    return [r[np.lexsort((r[:, 2], r[:, 0]))] for r in merged]


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edges)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def periodic_runs(text: Column, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> Column:
    """``{n_words, runs: [{start, length, period}], collapsed}`` of each text.

    ``runs`` are those of at least ``least_length`` words and ``least_periods`` (two or more) periods, by start and period;
    ``collapsed`` are the words that no run holds after its first period, joined by one space.
    """
    if least_periods < 2:
        raise ValueError("a run repeats its period at least twice")

    def rows(texts: list[list[bytes]]) -> Iterator[dict]:
        for words, runs in zip(texts, runs_of_all(texts, least_length, least_periods)):
            yield {
                "n_words": len(words),
                "runs": [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()],
                "collapsed": b" ".join(kept_words(words, runs)).decode("utf-8", "surrogatepass"),
            }

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        out, group, chars = [], [], 0
        for text in texts:
            group.append(words_of(text))
            chars += len(text or "")
            if chars >= GROUP_CHARS:
                out += rows(group)
                group, chars = [], 0
        out += rows(group)
        return pd.DataFrame(out, columns=FOUND.names)

    return find(F.coalesce(text, F.lit("")))


def find_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed`` of their ``text``, see :func:`periodic_runs`."""
    found = spare(docs, "found")
    added = {spare(docs, c): F.col(found)[c] for c in FOUND.names}
    return docs.withColumn(found, periodic_runs(docs["text"], least_length, least_periods)).withColumns(added).drop(found)


def looped(text: Column, doc_id: Column) -> Column:
    """The texts of the contract of ``op11``: a tenth of them repeat a period from some word on, the others are unchanged."""

    @F.pandas_udf(T.StringType())
    def repeat(texts: pd.Series, hashes: pd.Series) -> pd.Series:
        def one(text: str, h: int) -> str:
            if h % 10:
                return text
            words = words_of(text)
            if not words:
                return text
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            return b" ".join([*words[:a], *(words[a + i % p] for i in range(n - a))]).decode("utf-8", "surrogatepass")

        return pd.Series([one(t, int(h)) for t, h in zip(texts, hashes)], dtype=object)

    return repeat(F.coalesce(text, F.lit("")), F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(1).cast("long")))


def op11_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text"))
    found = find_runs(texts).select("doc_id", "runs", "collapsed")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    length, period = F.col("best.n"), -F.col("best.p")
    return best.select(
        "doc_id",
        "n_runs",
        (-F.col("best.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
