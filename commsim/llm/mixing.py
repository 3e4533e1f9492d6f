"""Mixing sources to target weights by Pfair scheduling. Spark expressions, aggregates, windows and joins only.

A source with weight share ``w`` gives its block number ``i`` the release time ``floor((i - 1) / w)`` and the deadline
``ceil(i / w)``, in slots of one block. Earliest deadline first among the released blocks then serves every block inside its
window, so no source is ever a whole block ahead of or behind its share. Weights are whole numbers, so the schedule repeats with
their sum; one period is scheduled, as a fold over its slots, and every block is placed by its period and its place in it.

Documents are numbered inside their source in the order of a hash, by counts per hash range and a row number inside
the range, so that a source of any size spreads over tasks. Every document gets a slot, none is dropped or
repeated: the slots of a source that has run out stay empty, and the others go on in the proportion of their weights.

Defined results: a null source counts as the source with an empty name; rows of equal id follow each other in either
order; a null id is an id like any other; sources without a weight, or with one below 1, get weight 1; an empty table
gives an empty result; other columns are not carried. The period's table has as many rows as the weights' sum and is the only
thing broadcast; :func:`scaled_weights` bounds that by :data:`QUANTUM` slots per source, and a mixture names its sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commsim.session import materialize, small

QUANTUM = 64
BLOCK_DOCS = 16
RANGE_DIGITS = 3

PLAN = "array<struct<source:string,j:bigint,release:bigint,deadline:bigint,slot:bigint>>"


def scaled_weights(sizes: DataFrame, quantum: int = QUANTUM) -> DataFrame:
    """``(source, weight)``: in proportion to the square root of ``n``, the largest at ``quantum``, the least at 1."""
    largest = F.max("n").over(Window.partitionBy())
    share = F.floor(F.sqrt(F.col("n").cast("double")) * quantum / F.sqrt(largest.cast("double")))
    return sizes.select("source", F.greatest(F.lit(1).cast("long"), share.cast("long")).alias("weight"))


def common_divisor(numbers: Column) -> Column:
    """The greatest common divisor of an array of whole numbers, by Euclid's steps, of which 64-bit numbers need under 92."""
    zero = F.lit(0).cast("long")

    def divisor(a: Column, b: Column) -> Column:
        step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), b.alias("b")), step, lambda s: s["a"])

    return F.greatest(F.lit(1).cast("long"), F.aggregate(numbers, zero, lambda d, n: divisor(n, d)))


def reduced_weights(weights: DataFrame) -> DataFrame:
    """``(source, weight)`` without the weights' common divisor, which shortens the period and leaves the schedule as it is."""
    asked = weights.agg(F.collect_list(F.struct("source", "weight")).alias("w"))
    asked = asked.withColumn("divisor", common_divisor(F.transform("w", lambda x: x["weight"])))
    rows = asked.select(F.explode("w").alias("x"), "divisor")
    return rows.select("x.source", F.floor(F.col("x.weight") / F.col("divisor")).alias("weight"))


def period_plan(weights: DataFrame) -> DataFrame:
    """``(source, j, release, deadline, slot, weight, period)``: the slots of one period of the weights ``(source, weight)``."""
    asked = weights.agg(F.sort_array(F.collect_list(F.struct("source", "weight"))).alias("w"))
    table = asked.withColumn("period", F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + x["weight"]))
    w, period = F.col("w"), F.col("period")

    def step(state, t):
        def block(i):
            weight, done = w[i]["weight"], state["done"][i]
            # Whole-number forms of floor and ceil; both are exact.
            return F.struct(
                F.floor(((done + 1) * period + weight - 1) / weight).alias("deadline"),
                i.alias("i"),
                F.floor(done * period / weight).alias("release"),
                (done < weight).alias("open"),
            )

        blocks = F.transform(F.sequence(F.lit(0), F.size(w) - 1), block)
        best = F.array_min(F.filter(blocks, lambda b: b["open"] & (b["release"] <= t)))
        chosen = F.struct(
            w[best["i"]]["source"].alias("source"),
            state["done"][best["i"]].alias("j"),
            best["release"].alias("release"),
            best["deadline"].alias("deadline"),
            t.alias("slot"),
        )
        return F.struct(
            F.transform(state["done"], lambda n, i: F.when(i == best["i"], n + 1).otherwise(n)).alias("done"),
            F.array_append(state["plan"], chosen).cast(PLAN).alias("plan"),
        )

    start = F.struct(F.transform(w, lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast(PLAN).alias("plan"))
    slots = F.sequence(F.lit(0).cast("long"), period - 1)
    plan = table.where("period > 0").select("w", "period", F.explode(F.aggregate(slots, start, step, lambda s: s["plan"])).alias("p"))
    own = F.element_at(F.filter(F.col("w"), lambda x: x["source"] == F.col("p.source")), 1)["weight"]
    return plan.select("p.*", own.alias("weight"), "period")


def numbered(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, number)``: places from 0 inside each source, in the order of the hashed ids."""
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), hashed.alias("hash"))
    rows = materialize(rows.withColumn("range", F.left("hash", F.lit(RANGE_DIGITS))), "hashed")
    counts = rows.groupBy("source", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    inside = Window.partitionBy("source", "range").orderBy("hash", "doc_id")
    placed = rows.withColumn("inside", F.row_number().over(inside) - 1)
    return placed.join(offsets, ["source", "range"]).select("doc_id", "source", (F.col("offset") + F.col("inside")).alias("number"))


def mix(docs: DataFrame, weights: DataFrame | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``(doc_id, source, block, place, release, deadline, slot)`` of every document; training order is by slot and place.

    ``weights`` is ``(source, weight)`` in whole numbers; without it, the square roots of the source sizes count.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        given = scaled_weights(sizes)
    else:
        asked = weights.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.max("weight").cast("long").alias("weight"))
        given = sizes.join(asked, "source", "left").select("source", F.greatest(F.lit(1).cast("long"), F.coalesce("weight", F.lit(1))).alias("weight"))
    plan = materialize(period_plan(reduced_weights(given)), "period")
    share = plan.select("source", "weight", "period").distinct()
    rows = numbered(docs).withColumn("block", F.floor(F.col("number") / block_docs))
    rows = rows.join(small(share), "source").withColumn("j", F.col("block") % F.col("weight"))
    cycle = F.floor(F.col("block") / F.col("weight")) * F.col("period")
    return rows.join(small(plan.drop("weight", "period")), ["source", "j"]).select(
        "doc_id",
        "source",
        "block",
        (F.col("number") % block_docs).alias("place"),
        *[(F.col(c) + cycle).alias(c) for c in ("release", "deadline", "slot")],
    )


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH RECURSIVE keyed AS (
    SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents),
sizes AS (SELECT source, count(*) AS n FROM keyed GROUP BY source),
weights AS (
    SELECT source, row_number() OVER (ORDER BY source) AS i,
           greatest(1, CAST(floor(sqrt(CAST(n AS DOUBLE)) * {QUANTUM} / sqrt(CAST(max(n) OVER () AS DOUBLE))) AS BIGINT)) AS weight
    FROM sizes),
mixture AS (SELECT list(weight ORDER BY i) AS w, CAST(sum(weight) AS BIGINT) AS period FROM weights),
edf AS (
    SELECT CAST(-1 AS BIGINT) AS slot, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS i, w, period
    FROM mixture
    UNION ALL
    SELECT slot + 1, list_transform(done, lambda c, k: CASE WHEN k = pick THEN c + 1 ELSE c END), pick, w, period
    FROM (
        SELECT slot, done, w, period, list_min(list_filter(list_transform(range(1, len(w) + 1), lambda k:
            CASE WHEN done[k] < w[k] AND done[k] * period // w[k] <= slot + 1
                 THEN (((done[k] + 1) * period + w[k] - 1) // w[k]) * 1000000 + k ELSE NULL END), lambda x: x IS NOT NULL)) % 1000000 AS pick
        FROM edf WHERE slot + 1 < period)),
plan AS (
    SELECT i, slot, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS j FROM edf WHERE slot >= 0),
numbers AS (
    SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY hash, doc_id) - 1 AS number FROM keyed),
blocks AS (
    SELECT n.doc_id, n.source, number // {BLOCK_DOCS} AS block, number % {BLOCK_DOCS} AS place, w.i, w.weight, m.period
    FROM numbers n JOIN weights w ON n.source = w.source CROSS JOIN mixture m)
SELECT b.doc_id, b.source, b.block, b.place, (b.block * b.period) // b.weight AS release,
       ((b.block + 1) * b.period + b.weight - 1) // b.weight AS deadline, p.slot + (b.block // b.weight) * b.period AS slot
FROM blocks b JOIN plan p ON p.i = b.i AND p.j = b.block % b.weight"""
