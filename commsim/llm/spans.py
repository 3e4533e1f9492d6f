"""Native regular-expression spans: matches of a text with code-point offsets, as Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = 40

SPAN_TYPE = "array<struct<start:bigint,stop:bigint,match:string,before:string,after:string>>"


def find_spans(text: Column, pattern: str, trigger: Column | None = None) -> Column:
    """All leftmost non-overlapping matches of the Java ``pattern``, which must not match an empty string.

    An array of ``(start, stop, match, before, after)``: offsets are code points, ``stop`` is exclusive, ``before``
    and ``after`` hold up to 40 characters between the match and its neighbour matches. The text between matches
    gives the offsets: ``split`` and ``regexp_extract_all`` walk through the same matches. Where ``trigger`` is
    false there is certainly no match and no search. A null text has no matches.
    """
    quoted = F.lit(pattern)
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, quoted, F.lit(0))
    zipped = F.zip_with(
        F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("piece"), m.alias("match"))),
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1))),
        lambda a, b: F.struct(a["piece"].alias("piece"), a["match"].alias("match"), b.alias("following")),
    )

    def step(state: Column, x: Column) -> Column:
        start = state["pos"] + F.length(x["piece"])
        stop = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(
            start.alias("start"),
            stop.alias("stop"),
            x["match"].alias("match"),
            F.right(x["piece"], F.lit(CONTEXT)).alias("before"),
            F.left(F.coalesce(x["following"], F.lit("")), F.lit(CONTEXT)).alias("after"),
        )
        found = F.when(x["match"].isNotNull(), F.array_append(state["found"], span)).otherwise(state["found"])
        return F.struct(stop.cast("long").alias("pos"), found.cast(SPAN_TYPE).alias("found"))

    start_state = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(SPAN_TYPE).alias("found"))
    found = F.aggregate(zipped, start_state, step, lambda s: s["found"])
    present = text.rlike(pattern) if trigger is None else trigger & text.rlike(pattern)
    return F.when(F.coalesce(present, F.lit(False)), found).otherwise(F.array().cast(SPAN_TYPE))


def tag(spans: Column, kind: str, rank: int, value, score) -> Column:
    """Spans as ``(start, rank, stop, kind, value, score)``; ``value`` and ``score`` are functions of a span."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            s["stop"].alias("stop"),
            F.lit(kind).alias("kind"),
            value(s).alias("value"),
            score(s).cast("double").alias("score"),
        ),
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of ordered spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
