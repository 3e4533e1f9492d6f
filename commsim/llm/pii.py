"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score. Spark expressions only.

Every kind is one pattern (:data:`PATTERNS`), an optional validity test and a prior score. Words within 40 characters,
but not beyond a neighbour match of the same kind, raise or lower the score. Spans of the kinds in :data:`BASE` stay
whatever their score; those of other kinds stay from :data:`KEEP` on.

Defined results: a null text counts as empty and has no spans; a row keeps its null ``doc_id``; repeated rows are
judged each; equal starts are ordered by kind. Patterns are written without backtracking over long runs, so
the time is linear in the length of a text, which is always read to its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commsim.llm.spans import count_kind, find_spans, joined, tag

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
KEEP = 0.5

# Lookbehinds and possessive quantifiers only save retries inside one run of characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
TRIGGERS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
SUPPORT = {
    "email": r"\b(?:e-?mail|contact|write|reply|correo|courriel)\b",
    "ip": r"\b(?:ip|host|server|address|login|client)\b",
    "card": r"\b(?:card|credit|debit|visa|mastercard|amex|payment|cvv|karte|carte|tarjeta)\b",
    "phone": r"\b(?:phone|call|tel|telefon|mobile|cell|fax|whatsapp)\b",
    "iban": r"\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"\b(?:ssn|social|security)\b",
}
DOUBT = r"\b(?:example|sample|dummy|test|version|order|invoice|isbn|serial)\b"
UP, DOWN = 0.2, 0.3


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check: every second digit from the right is doubled."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.struct(d.cast("int").alias("d"), (i % 2).alias("odd")))
    total = F.aggregate(
        places,
        F.lit(0),
        lambda s, x: s + F.when(x["odd"] == 1, x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)).otherwise(x["d"]),
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code gives 1 modulo 97 with its first four signs moved to the end and letters as 10 to 35."""
    moved = F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4)))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _valid(kind: str, span: Column) -> Column:
    number = digits(span["match"])
    if kind == "ip":
        return ~F.exists(F.split(span["match"], r"\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(number).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(span["match"], F.lit(" "), F.lit("")))
    return F.lit(True)


def _score(kind: str, span: Column) -> Column:
    near = F.lower(F.concat_ws(" ", span["before"], span["after"]))
    value = F.lit(PRIOR[kind]) + F.when(near.rlike(SUPPORT[kind]), UP).otherwise(0.0) - F.when(near.rlike(DOUBT), DOWN).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 3)


def _judge(rule, kind: str):
    return lambda span: rule(kind, span)


def find(text: Column) -> Column:
    """Array of spans ``(start, rank, stop, kind, value, score)`` of a text, by start and kind."""
    text = F.coalesce(text, F.lit(""))
    found = []
    for rank, kind in enumerate(KINDS):
        trigger = text.contains(TRIGGERS[kind]) if kind in TRIGGERS else None
        spans = F.filter(find_spans(text, PATTERNS[kind], trigger), _judge(_valid, kind))
        found.append(tag(spans, kind, rank, lambda s: s["match"], _judge(_score, kind)))
    kept = F.filter(F.concat(*found), lambda s: (s["rank"] < len(BASE)) | (s["score"] >= KEEP))
    return F.array_sort(kept)


def personal_data(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """All columns of ``docs`` and the array ``out`` of the spans of :func:`find`; replaces a column of that name."""
    return docs.withColumn(out, find(F.col(text)))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = personal_data(docs.select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *[count_kind(F.col("pii"), kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.array_min(F.transform("pii", lambda s: s["score"])).alias("least_score"),
        F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score"),
    )
