"""Dense ids, sparse matrix components and blocked sparse vectors."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commsim.session import fits_broadcast, materialize

ROW_BITS = 33
EXPAND_CHUNK = 10_000
MAX_SMALL = 1_000_000


@dataclass(frozen=True)
class DenseIndex:
    """A written ``(value, index)`` table with ids 0 to ``size - 1`` in value order."""

    frame: DataFrame
    size: int

    @cached_property
    def is_small(self) -> bool:
        """Whether the table, by its measured size, may be broadcast."""
        return self.size <= MAX_SMALL and fits_broadcast(self.frame)

    def bounded(self, df: DataFrame) -> DataFrame:
        """``df``, which has at most one narrow row per indexed value, marked for broadcast if the index is small."""
        return F.broadcast(df) if self.is_small else df


def number_rows(rows: DataFrame, by: str, index: str = "index") -> DenseIndex:
    """Add dense ids to ``rows``, in order of the unique column ``by``, without sorting them in one place.

    Rows are range-partitioned and sorted, and each row's place in its partition is written with it, so a
    later re-read or retry cannot renumber. Only the partition sizes reach the driver.
    """
    placed = (
        rows.repartitionByRange(by)
        .sortWithinPartitions(by)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    )
    stored = materialize(placed, "index")
    sizes = sorted(stored.groupBy("part").agg((F.max("place") + 1).alias("n")).collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    starts = rows.sparkSession.createDataFrame(offsets, "part int, start bigint")
    numbered = stored.join(F.broadcast(starts), "part")
    return DenseIndex(numbered.select(*rows.columns, (F.col("start") + F.col("place")).alias(index)), total)


def dense_index(values: DataFrame, value: str, index: str = "index") -> DenseIndex:
    """Number the distinct ``value``s in their own order."""
    return number_rows(values.select(value).distinct(), value, index)


def components(edges: DataFrame, index: DenseIndex, feature: str, community: str = "subreddit") -> DataFrame:
    """``(community, index)`` components of distinct edges, a sparse binary matrix."""
    return edges.join(index.frame, feature).select(community, "index")


def repeated_components(edges: DataFrame, index: DenseIndex, feature: str, community: str = "subreddit") -> DataFrame:
    """Components of edges that may repeat, each as often as its edge; null features drop out.

    Repeats are counted before the join, so a feature with very many rows meets the index once per
    community, and are written out again in chunks that spread over all tasks.
    """
    counted = edges.groupBy(community, feature).agg(F.count("*").alias("n"))
    joined = counted.join(index.frame, feature).select(community, "index", "n")
    last_chunk = F.floor((F.col("n") - 1) / EXPAND_CHUNK)
    chunks = joined.select(community, "index", "n", F.explode(F.sequence(F.lit(0), last_chunk)).alias("chunk"))
    here = F.least(F.lit(EXPAND_CHUNK), F.col("n") - F.col("chunk") * EXPAND_CHUNK)
    spread = chunks.repartition(community, "index", "chunk")
    return spread.select(community, "index", F.explode(F.array_repeat(F.lit(1), here.cast("int")))).drop("col")


def community_vectors(parts: DataFrame, size: int, block: int = 4096, community: str = "subreddit") -> DataFrame:
    """Binary sparse vectors in blocks: ``(community, block, size, indices)``.

    ``parts`` are distinct components. A community's vector has as many entries as it has features, too
    many for one row. Each row holds the sorted ids of one range of ``block`` dimensions; ``size`` is the
    length of the whole vector.
    """
    blocked = parts.withColumn("block", F.floor(F.col("index") / block))
    grouped = blocked.groupBy(community, "block").agg(F.sort_array(F.collect_list("index")).alias("indices"))
    return grouped.select(community, "block", F.lit(size).cast("long").alias("size"), "indices")


def dense_blocks(vectors: DataFrame, size: int, block: int = 4096, community: str = "subreddit") -> DataFrame:
    """The blocks of :func:`community_vectors` as sparse vectors of their own: ``(community, block, length, local)``.

    ``local`` counts from the block's first dimension, as a library for sparse vectors wants it.
    """
    base = F.col("block") * block
    length = F.least(F.lit(block), F.lit(size) - base).cast("int")
    return vectors.select(community, "block", length.alias("length"), F.transform("indices", lambda i: (i - base).cast("int")).alias("local"))


def ml_vectors(vectors: DataFrame, size: int, block: int = 4096, community: str = "subreddit", column: str = "vector") -> DataFrame:
    """The blocks of :func:`community_vectors` as ML sparse vectors of ``block`` dimensions: ``(community, block, length, vector)``.

    A fitted-by-hand count vectorizer over the dimensions' numbers builds them inside the JVM; entries are 1, and dimensions from
    ``length`` on are empty in the last block.
    """
    local = dense_blocks(vectors, size, block, community)
    named = local.withColumn("local", F.transform("local", lambda i: i.cast("string")))
    model = CountVectorizerModel.from_vocabulary([str(i) for i in range(block)], "local", column)
    return model.setBinary(True).transform(named).select(community, "block", "length", column)
