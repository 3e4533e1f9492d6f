"""SimHash near-duplicates with bit-sliced comparison.

A text's fingerprint is the bitwise majority of the hashes of its word shingles. Two fingerprints link when they
differ in few bits. The 64 bits are cut into parts, of which a linked pair must agree in all but ``radius``; distinct
fingerprints that agree in such a choice of parts share a bucket and are compared bit-sliced: the bucket's bits
stand in vertical planes, 64 fingerprints to a word, and the distances of one fingerprint to all of them grow in
carry-save counters, plane by plane. A row of counters is abandoned as soon as all of them exceed the radius.

A bucket gives the edges of a spanning forest only, never its pairs. Buckets over :data:`CHUNK` fingerprints are
cut into chunks, and every pair of chunks is one task. Equal fingerprints count as one; their documents are never paired.

Defined results: null and empty texts have the fingerprint zero, linked like any other; rows with a null id have a
null component and influence nothing; repeated rows give repeated results; an empty table gives an empty
result. Whole texts are read. :func:`keep_first` keeps all columns of the input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commsim.llm.columns import spare
from commsim.llm.components import components
from commsim.session import materialize

SEED = 42
WORDS = 3
RADIUS = 2
PARTS = 5
CHUNK = 4096
FEW = 1 << 14  # up to so many pairs, planes cost more than they save
HASH_STEP = 1 << 15


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's word shingles in their order; of all its words, if they are fewer than ``words``."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(words, len(tokens))
    first, last = starts[: len(tokens) - span + 1].tolist(), ends[span - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(first, last)), np.uint64, len(first))


def majority(hashes: np.ndarray) -> int:
    """The bitwise majority of ``hashes`` as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASH_STEP):
        part = hashes[at : at + HASH_STEP].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit number."""
    return majority(shingle_hashes(text, words))


def fingerprint(text: Column, words: int = WORDS) -> Column:
    @F.pandas_udf(T.LongType())
    def fingerprints(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint_of(t, words)).astype("int64")

    return fingerprints(F.coalesce(text, F.lit("")))


def bit_planes(values: np.ndarray) -> np.ndarray:
    """``planes[k, w]``: bit ``j`` is bit ``k`` of ``values[64 * w + j]``; places beyond the last value repeat the first."""
    width = -(-len(values) // 64)
    padded = np.full(width * 64, values[0], np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(queries: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(query, value)`` of all pairs that differ in at most ``radius`` bits."""
    if len(queries) * len(values) <= FEW:
        return np.nonzero(np.bitwise_count(queries[:, None] ^ values[None, :]) <= radius)
    planes = bit_planes(values)
    counters = max(1, int(radius + 1).bit_length())
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    found_q, found_v = [], []
    step = max(1, (1 << 16) // planes.shape[1])
    for at in range(0, len(queries), step):
        rows = np.arange(at, min(at + step, len(queries)))
        count = np.zeros((counters, len(rows), planes.shape[1]), np.uint64)
        over = np.zeros((len(rows), planes.shape[1]), np.uint64)
        for k in range(64):
            flip = ((queries[rows] >> np.uint64(k)) & np.uint64(1)) * full
            carry = planes[k][None, :] ^ flip[:, None]
            for c in range(counters):
                count[c], carry = count[c] ^ carry, count[c] & carry
            over |= carry
            exceeds = np.zeros_like(over)  # compares the counters with radius, from the highest bit down
            equal = np.full_like(over, full)
            for c in reversed(range(counters)):
                if radius >> c & 1:
                    equal &= count[c]
                else:
                    exceeds |= equal & count[c]
                    equal &= ~count[c]
            over |= exceeds
            if k % 8 == 7:
                alive = ~(over == full).all(axis=1)
                if not alive.all():
                    rows, over, count = rows[alive], over[alive], count[:, alive]
                if not len(rows):
                    break
        if len(rows):
            within = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, : len(values)]
            q, v = np.nonzero(within)
            found_q.append(rows[q])
            found_v.append(v)
    if not found_q:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_v)


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges from the smallest id of each component of the links ``(a, b)``, given as positions, to its other ids."""
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            if ids[x] < ids[y]:
                parent[y] = x
            else:
                parent[x] = y
    others = [x for x in range(len(ids)) if root(x) != x]
    return [int(ids[root(x)]) for x in others], [int(ids[x]) for x in others]


def choices(parts: int = PARTS, radius: int = RADIUS) -> list[int]:
    """Masks of the bits in which a linked pair may agree: one for each choice of ``parts - radius`` parts."""
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    masks = [sum(1 << k for k in range(edges[i], edges[i + 1])) for i in range(parts)]
    return [sum(c) for c in combinations(masks, parts - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        data = pd.concat(rows, ignore_index=True)
        data = data.sort_values(["choice", "bucket", "task"], kind="stable")
        keys = data[["choice", "bucket", "task"]].to_numpy()
        cuts = np.concatenate(([0], np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1, [len(keys)]))
        ids, prints, side = data["id"].to_numpy(np.int64), data["print"].to_numpy(np.int64).view(np.uint64), data["side"].to_numpy()
        a, b = [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if hi - lo < 2:
                continue
            own, far = np.nonzero(side[lo:hi] != 1)[0] + lo, np.nonzero(side[lo:hi] != 0)[0] + lo
            if not len(own) or not len(far):
                continue
            q, v = near(prints[own], prints[far], radius)
            x, y = own[q] - lo, far[v] - lo
            linked = ids[lo + x] != ids[lo + y]
            if linked.any():
                low, high = forest(ids[lo:hi], x[linked], y[linked])
                a += low
                b += high
        if a:
            yield pd.DataFrame({"a": a, "b": b})

    return run


def links(prints: DataFrame, radius: int = RADIUS, parts: int = PARTS, chunk: int = CHUNK) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct fingerprints ``(id, print)`` linked by chains of at most ``radius`` bits."""
    masks = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(choices(parts, radius))])
    rows = prints.select("id", "print", F.explode(masks).alias("m")).select(
        "id", "print", F.col("m.choice").alias("choice"), F.col("print").bitwiseAND(F.col("m.mask")).alias("bucket")
    )
    return bucket_links(rows, radius, chunk)


def bucket_links(rows: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Edges ``(a, b)`` that connect what chains of at most ``radius`` bits link inside the buckets of ``(id, print, choice, bucket)``."""
    sizes = rows.groupBy("choice", "bucket").agg(F.count("*").alias("n"))
    hot = materialize(sizes.where(F.col("n") > chunk), "hot_buckets")
    plain = rows.withColumns({"task": F.lit(0).cast("long"), "side": F.lit(2)})
    if not hot.isEmpty():
        tagged = rows.join(hot, ["choice", "bucket"], "left")
        n = F.ceil(F.col("n") / chunk)
        own = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("print"), n))
        others = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), n - 1))
        spread = tagged.select("id", "print", "choice", "bucket", "n", own.alias("own"), F.explode(others).alias("other"))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        plain = spread.select("id", "print", "choice", "bucket", (low * (1 << 31) + high).alias("task"), side.alias("side"))
    dealt = plain.repartition("choice", "bucket", "task")
    return dealt.mapInPandas(_compare(radius), "a long, b long")


def clusters(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(print, component)`` of every fingerprint of the rows ``(doc_id, print)``; ``component`` is the smallest id reachable."""
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("id")).where("id IS NOT NULL")
    distinct = materialize(distinct, "fingerprints")
    joined = components(links(distinct, radius)).withColumnRenamed("node", "id")
    found = distinct.join(joined, "id", "left").select("print", F.coalesce("component", "id").alias("component"))
    return materialize(found, "clusters")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """``(doc_id, print, component_id)``, one row for every row of ``docs``."""
    prints = materialize(docs.select("doc_id", fingerprint(F.col("text"), words).alias("print")), "prints")
    found = prints.join(clusters(prints, radius), "print", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return found.select("doc_id", "print", own.alias("component_id"))


def keep_first(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """The documents of ``docs`` without those whose near-duplicates include a smaller id; null ids stay."""
    found = near_duplicates(docs, radius, words)
    dropped = spare(docs, "dropped")
    extra = found.where("doc_id <> component_id").select(F.col("doc_id").alias(dropped)).distinct()
    extra = materialize(extra, "near_copies")
    return docs.join(extra, docs["doc_id"] == extra[dropped], "left_anti")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
