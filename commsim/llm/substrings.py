"""Substring dedup by level-wise doubling: runs of words that already start in an earlier document are removed.

Windows of half the wanted length come first. Of these, each full window needs only the one with the smallest hash inside
it (winnowing), which two equal full windows share wherever they stand; so a fourteenth of the half windows is
shuffled and no repeat is lost. Half windows that are in one document alone end here. The others are extended to twice their
length, as far as they are the smallest of their full window, and the full windows are counted in turn: each learns the smallest
document that holds it. With the wanted length reached the doubling ends, as longer repeats are chains of these windows.

Texts equal as a whole count once: all but the smallest document lose all words if they have a window at all. Counting is by
aggregates that combine map-side, and results come back by plain joins of written tables, whose hot keys adaptive
execution splits. Lists are collected per document only. Windows are compared by 96 bits of hash.

Defined results: null and empty texts have no words; texts under one window stay whole; a row without an id is neither removed nor
a source; rows of the same id are no repeat of each other; repeated rows get equal results; an empty table gives
an empty result. Whole texts are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commsim.session import materialize

LENGTH = 50
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD = 1 << 64
POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def words_of(text: str | None) -> list[bytes]:
    """Words between the ASCII white space signs."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64; remembered in a plain table, which travels to workers by value."""
    if (base, n) in POWERS:
        return POWERS[base, n]
    out = []
    for b in (base, pow(base, -1, WORD)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    if len(POWERS) >= 8:
        POWERS.clear()
    POWERS[base, n] = (out[0], out[1])
    return POWERS[base, n]


def rolling(hashes: np.ndarray, length: int, base: int) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` words."""
    n = len(hashes)
    up, down = powers(base, 1 << max(10, int(n).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)))
    h = (sums[length:] - sums[:-length]) * down[: n - length + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def smallest_halves(hashes: np.ndarray, length: int) -> np.ndarray:
    """For every full window the smallest hash of the half windows inside it."""
    halves = rolling(hashes, length // 2, BASES[0])
    return np.lib.stride_tricks.sliding_window_view(halves, length - length // 2 + 1).min(axis=1)


def _halves(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, digests, halves = [], [], []
            for text, doc_id in zip(batch["text"], batch["doc_id"]):
                words = words_of(text)
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                few = len(words) < length or pd.isna(doc_id)
                halves.append([] if few else np.unique(smallest_halves(word_hashes(words), length)).view(np.int64))
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64"), "key": batch["key"], "n_words": counts, "whole": digests, "halves": halves}
            )

    return run


def _windows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            starts, high, low = [], [], []
            for text, repeated in zip(batch["text"], batch["repeated"]):
                hashes = word_hashes(words_of(text))
                held = np.isin(smallest_halves(hashes, length), np.asarray(repeated, np.int64).view(np.uint64))
                at = np.nonzero(held)[0]
                starts.append(at)
                high.append(rolling(hashes, length, BASES[0])[at].view(np.int64))
                low.append((rolling(hashes, length, BASES[1])[at] >> np.uint64(33)).astype(np.int32))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"], "starts": starts, "high": high, "low": low})

    return run


def _cut(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            removed, digests = [], []
            for text, starts in zip(batch["text"], batch["starts"]):
                words = words_of(text)
                at = np.asarray(starts, np.int64)
                edges = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + length, minlength=len(words) + 1)
                gone = np.cumsum(edges)[: len(words)] > 0
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"], "n_removed": removed, "kept_sha256": digests})

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``(doc_id, text)`` repeat: ``(every row, first of equal texts, window starts to remove)``."""
    keyed = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    schema = "doc_id long, key string, n_words long, whole string, halves array<long>"
    level = materialize(keyed.mapInPandas(_halves(length), schema), "halves")
    firsts = level.where(f"n_words >= {length} AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    firsts = materialize(firsts, "firsts")

    first_halves = level.join(firsts, ["key", "doc_id"]).select("doc_id", "key", F.explode("halves").alias("half"))
    spread = first_halves.groupBy("half").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    repeated = materialize(spread.where("least <> most").select("half"), "repeated_halves")
    candidates = first_halves.join(repeated, "half").groupBy("doc_id", "key").agg(F.collect_set("half").alias("repeated"))

    texts = materialize(keyed.join(materialize(candidates, "candidates"), ["doc_id", "key"]), "candidate_texts")
    runs = texts.mapInPandas(_windows(length), "doc_id long, key string, starts array<int>, high array<long>, low array<int>")
    runs = materialize(runs, "windows")
    windows = runs.select("doc_id", "key", F.explode(F.arrays_zip("starts", "high", "low")).alias("w")).select(
        "doc_id", "key", F.col("w.starts").alias("start"), F.col("w.high").alias("high"), F.col("w.low").alias("low")
    )
    earliest = windows.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    earliest = materialize(earliest.where("least <> most").select("high", "low", "least"), "earliest")
    later = windows.join(earliest, ["high", "low"]).where("doc_id > least")
    starts = later.groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))
    return level.drop("halves"), firsts, texts.select("doc_id", "key", "text").join(materialize(starts, "starts"), ["doc_id", "key"])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row of ``docs``."""
    every, firsts, hit = repeated_windows(docs, length)
    cut = hit.mapInPandas(_cut(length), "doc_id long, key string, n_removed long, kept_sha256 string").dropDuplicates(["doc_id", "key"])
    first = firsts.withColumnRenamed("doc_id", "first")
    known = materialize(first.join(cut.withColumnRenamed("doc_id", "first"), ["key", "first"], "left"), "known")
    copy = F.col("doc_id") > F.col("first")
    return every.join(known, "key", "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(F.col("doc_id") == F.col("first"), F.coalesce("n_removed", F.lit(0))).otherwise(0).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256().hexdigest()))
        .when(F.col("doc_id") == F.col("first"), F.coalesce("kept_sha256", "whole"))
        .otherwise(F.col("whole"))
        .alias("kept_sha256"),
    )


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
