"""Embedding near-duplicates by sorted projection passes.

Every pass hashes a vector to the signs of 64 random projections and orders the vectors of one label and dimension
lexicographically by these bits. Vectors at a small angle share long beginnings, so each is compared with a bounded
window of its followers. Vectors with the same first bits make a bucket. The number of passes follows from the number of
vectors: it makes the chance that a linked pair at the limit shares a bucket in no pass less than :data:`MISS`,
however the vectors are spread.

A window covers a whole bucket unless more vectors crowd in it. Crowded buckets are counted in every pass, and those that
hold vectors of several components found by the windows are compared in blocks, where only links between components
matter. Links of windows and blocks are united; then the members of each component are compared in blocks, so
that groups wider than a window have exact link counts.

Equal vectors count as one with a number of copies. A pass sorts by range, whole buckets to a task except the largest,
which are spread by their keys. Blocks are pairs of chunks; no pair of vectors leaves a task unless it is a link.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label, link with
nothing; so do vectors of different dimensions; repeated rows of an id count as one vector, and each gets the result; a row
without an id influences nothing and has a null component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commsim.llm.components import components
from commsim.session import materialize, small

LEAST = 0.98
WINDOW = 24
MISS = 1e-6
BITS = 64
CHUNK = 1024
SEED = 20


def usable(embedding: str = "embedding"):
    """Whether a vector has only finite components, not all of them zero."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def bucket_bits(vectors: int, window: int = WINDOW) -> int:
    """Bits of a bucket; vectors that spread evenly fill a quarter of a window, so few buckets need blocks."""
    return min(BITS - 1, max(4, math.ceil(math.log2(max(2, vectors) / max(1, window / 4)))))


def n_passes(vectors: int, least: float = LEAST, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair at the limit has shared a bucket but for the chance ``miss``.

    A bit of such a pair agrees with probability ``1 - angle / pi``, and pairs that share :func:`bucket_bits` bits are compared.
    """
    together = (1 - math.acos(least) / math.pi) ** bucket_bits(vectors, window)
    return max(1, math.ceil(math.log(miss) / math.log1p(-together)))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows, in double precision, of lists of equal length; scaled first so that squares neither overflow nor vanish."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _hashed(passes: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.nonzero(dims == dim)[0]))
                if dim not in planes:
                    planes[dim] = np.random.default_rng((seed, dim)).standard_normal((dim, passes * BITS))
                signs = matrix(part.column("embedding")) @ planes[dim] > 0
                names = part.schema.names
                for p in range(passes):
                    words = np.packbits(signs[:, p * BITS : (p + 1) * BITS], axis=1).view(">u8").ravel().astype(np.uint64)
                    key = (words ^ np.uint64(1 << 63)).view(np.int64)
                    own = [pa.array(np.full(len(part), p, np.int32)), pa.array(key), pa.array(key >> (BITS - bits))]
                    yield pa.RecordBatch.from_arrays([*own, *part.columns], names=["pass", "key", "bucket", *names])

    return run


def _windows(least: float, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None
        for batch in batches:
            whole = pa.Table.from_batches([b for b in (kept, batch) if b is not None]).combine_chunks()
            old = len(kept) if kept is not None else 0
            group = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in ("label", "dim", "pass")])
            ids, a, b = whole.column("rep").to_numpy(), [], []
            cuts = np.concatenate(([0], np.nonzero((group[:, 1:] != group[:, :-1]).any(axis=0))[0] + 1, [len(whole)]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hi - lo < 2:
                    continue
                unit = matrix(whole.column("embedding").slice(lo, hi - lo))
                for ahead in range(1, min(window, hi - lo - 1) + 1):
                    near = np.nonzero(np.einsum("ij,ij->i", unit[:-ahead], unit[ahead:]) >= least)[0]
                    near = near[near + lo + ahead >= old]  # pairs of rows kept from before have been compared
                    a.append(ids[near + lo])
                    b.append(ids[near + lo + ahead])
            if a:
                x, y = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
            kept = whole.slice(max(0, len(whole) - window)).combine_chunks().to_batches()[0] if len(whole) else None

    return run


BUCKET = ["label", "dim", "pass", "bucket"]


@dataclass
class Passes:
    """The rows of all passes over ``(rep, label, dim, embedding)`` and the buckets in which more than a window's rows crowd."""

    vectors: DataFrame
    least: float = LEAST
    window: int = WINDOW
    miss: float = MISS
    seed: int = SEED

    def __post_init__(self) -> None:
        largest = self.vectors.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        self.bits, self.number = bucket_bits(largest, self.window), n_passes(largest, self.least, self.window, self.miss)
        counts = self.dealt(self.vectors.select("rep", "label", "dim", "embedding")).groupBy(*BUCKET).agg(F.count("*").alias("rows"))
        self.crowded = materialize(counts.where(F.col("rows") > self.window + 1), "crowded")

    def dealt(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` once for every pass, with ``pass``, ``key`` and ``bucket``."""
        schema = T.StructType().add("pass", T.IntegerType()).add("key", T.LongType()).add("bucket", T.LongType())
        return vectors.mapInArrow(_hashed(self.number, self.bits, self.seed), T.StructType(schema.fields + vectors.schema.fields))

    def window_links(self) -> DataFrame:
        """Distinct links ``(a, b)`` met in the windows."""
        huge = materialize(self.crowded.where(F.col("rows") > CHUNK), "huge")
        dealt = self.dealt(self.vectors.select("rep", "label", "dim", "embedding")).join(small(huge), BUCKET, "left")
        spread = F.when(F.col("rows").isNotNull(), F.col("key")).otherwise(0)
        partitions = int(self.vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = dealt.withColumn("spread", spread).repartitionByRange(partitions, *BUCKET, "spread")
        ordered = ordered.sortWithinPartitions(*BUCKET, "key", "rep").select("label", "dim", "pass", "rep", "embedding")
        return ordered.mapInArrow(_windows(self.least, self.window), "a long, b long").distinct()

    def block_links(self, joined: DataFrame) -> DataFrame | None:
        """Links ``(a, b)`` between the components of ``(rep, component)`` in crowded buckets; None if none holds two components.

        A bucket's rows of components beyond a chunk's size stand in chunks of their own, which do not meet each other.
        """
        if self.crowded.isEmpty():
            return None
        sizes = materialize(joined.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > CHUNK), "sizes")
        grouped = self.vectors.join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        grouped = grouped.join(small(sizes), "component", "left").select("rep", "label", "dim", "embedding", "component", "size")
        grouped = materialize(grouped, "grouped")
        part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / CHUNK))
        chunk = F.when(F.col("size").isNotNull(), F.struct(F.col("component").alias("of"), part.alias("no")))
        rows = self.dealt(grouped).drop("key").join(small(self.crowded), BUCKET)
        stats = rows.groupBy(*BUCKET).agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.count(F.when(F.col("size").isNull(), 1)).alias("loose"),
            F.collect_set(chunk).alias("pure"),
        )
        mixed = materialize(stats.where("low <> high").select(*BUCKET, F.ceil(F.col("loose") / CHUNK).alias("loose"), "pure"), "mixed")
        if mixed.isEmpty():
            return None
        rows = self.dealt(grouped).drop("key").join(small(mixed), BUCKET)
        nobody, some = F.lit(None).cast("long"), F.greatest("loose", F.lit(1))
        loose = F.transform(F.sequence(F.lit(0).cast("long"), some - 1), lambda i: F.struct(nobody.alias("of"), i.alias("no")))
        others = F.when(F.col("loose") > 0, F.concat(loose, "pure")).otherwise(F.col("pure"))
        own = F.coalesce(chunk, F.struct(nobody.alias("of"), F.pmod(F.xxhash64("rep"), some).alias("no")))
        rows = rows.select(*BUCKET, "component", "embedding", own.alias("own"), others.alias("others"))
        met = F.explode(F.filter("others", lambda o: F.col("own.of").isNull() | o["of"].isNull() | (o["of"] != F.col("own.of"))))
        rows = rows.select(*BUCKET, "component", "embedding", "own", met.alias("other"))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        block = F.struct(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        keys = [*BUCKET, "block"]
        blocks = rows.select(*BUCKET, block.alias("block"), "component", "embedding", side.alias("side")).repartition(*keys)
        return blocks.groupBy(*keys).applyInArrow(_link_block(self.least), "a long, b long").distinct()


def _link_block(least: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        own, far = np.nonzero(side != 1)[0], np.nonzero(side != 0)[0]
        component = table.column("component").to_numpy()
        links = [np.empty((0, 2), np.int64)]
        if len(own) and len(far) and component.min() != component.max():
            unit = matrix(table.column("embedding"))
            for at in range(0, len(own), 256):
                rows = own[at : at + 256]
                i, j = np.nonzero((unit[rows] @ unit[far].T >= least) & (component[rows][:, None] != component[far]))
                x, y = component[rows[i]], component[far[j]]
                links.append(np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0))
        a, b = np.unique(np.concatenate(links), axis=0).T
        return pa.table({"a": a, "b": b})

    return run


def _count_block(least: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        own, far = np.nonzero(side != 1)[0], np.nonzero(side != 0)[0]
        unit, ids = matrix(table.column("embedding")), table.column("rep").to_numpy()
        copies = table.column("copies").to_numpy()
        same = len(own) == len(table) and len(far) == len(table)
        total = np.zeros(len(table), np.int64)
        for at in range(0, len(own), 256):
            rows = own[at : at + 256]
            linked = unit[rows] @ unit[far].T >= least
            if same:
                linked[np.arange(len(rows)), rows] = False
            total[rows] += linked @ copies[far]
            if not same:
                total[far] += copies[rows] @ linked
        return pa.table({"rep": ids, "links": total})

    return run


def exact_counts(members: DataFrame, least: float = LEAST, chunk: int = CHUNK) -> DataFrame:
    """``(rep, links)``: linked vectors of each rep of ``(rep, component, copies, embedding)``, its own copies left out."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    sized = members.join(materialize(sizes, "sizes"), "component")
    n = F.ceil(F.col("n") / chunk)
    own = F.pmod(F.xxhash64("rep"), n)
    spread = sized.select("component", "rep", "copies", "embedding", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    blocks = spread.select(
        "component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side.alias("side"), "rep", "copies", "embedding"
    )
    counted = blocks.groupBy("component", "low", "high").applyInArrow(_count_block(least), "rep long, links long")
    return counted.groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, least: float = LEAST, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for every row of ``(vec_id, embedding, label)``."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # halves what is shuffled; tasks reckon in doubles
    plain = vectors.select("vec_id", "label", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    good = usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = materialize(plain.withColumn("hash", F.when(good, F.sha2(F.to_json(F.struct("embedding")), 256))), "vectors")
    same = ["label", "hash"]
    reps = (
        keyed.where("hash IS NOT NULL")
        .groupBy(*same)
        .agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding"))
    )
    reps = materialize(reps, "reps")
    passes = Passes(reps, least, window, miss)
    links = materialize(passes.window_links(), "links")
    joined = materialize(components(links), "joined").withColumnRenamed("node", "rep")
    crossing = passes.block_links(joined)
    if crossing is not None:
        crossing = materialize(crossing, "crossing")
        if not crossing.isEmpty():
            joined = materialize(components(links.unionByName(crossing)), "joined").withColumnRenamed("node", "rep")
    members = materialize(reps.join(joined, "rep").select("rep", "component", "copies", "embedding"), "members")
    counts = exact_counts(members, least)
    known = (
        reps.select(*same, "rep", "copies")
        .join(members.select("rep", "component"), "rep", "left")
        .join(counts, "rep", "left")
        .select(*same, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    known = materialize(known, "known")
    out = keyed.select("vec_id", *same).join(known, same, "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op2_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
