"""Secrets: patterns propose credentials, and corpus-wide ownership tells live-looking ones from copied examples.

Every candidate value is hashed; the corpus is aggregated to the distinct repositories and owners of each hash.
A value that several owners or many repositories hold is an example that has been copied around; a value of few looks live.
Spark expressions, aggregates and joins only.

Defined results: a null text counts as empty; a null repository or owner counts as one further value; repeated rows
count once in the ownership, as it counts distinct values, and each gets its result; an empty table gives an
empty result; other columns are left out of :func:`findings` and kept by :func:`redact`. Texts are read to
their end, and a value held by very many documents is one small row per owner after map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commsim.llm.columns import spare
from commsim.llm.spans import count_kind, find_spans, joined, tag
from commsim.session import materialize

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem")
SHARED_OWNERS = 3
SHARED_REPOSITORIES = 4
MASK = "[SECRET]"

# The hex and access patterns ask for the least length at once, which finds the same long runs without the short ones.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+-----END [A-Z ]{0,40}PRIVATE KEY-----",
}
TRIGGERS = {"access": "AKIA", "jwt": "eyJ", "pem": "PRIVATE KEY-----"}
ASSIGNED = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _value(kind: str, span: Column) -> Column:
    return F.regexp_extract(span["match"], f"^{ASSIGNED}$", 1) if kind == "assign" else span["match"]


def find(text: Column) -> Column:
    """Array of spans ``(start, rank, stop, kind, value, score)`` by start and kind; ``score`` is unused and 1."""
    text = F.coalesce(text, F.lit(""))
    found = []
    for rank, kind in enumerate(KINDS):
        trigger = text.contains(TRIGGERS[kind]) if kind in TRIGGERS else None
        spans = tag(
            find_spans(text, PATTERNS[kind], trigger), kind, rank, lambda s, kind=kind: _value(kind, s), lambda s: F.lit(1.0)
        )
        found.append(F.filter(spans, lambda s: F.length(s["value"]) >= 6) if kind == "assign" else spans)
    return F.array_sort(F.concat(*found))


def findings(docs: DataFrame, repository: Column, owner: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text_hash, repository, owner, spans)`` of every row, written once because ownership and results both read it."""
    found = docs.select(
        F.col(key).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
        repository.alias("repository"),
        owner.alias("owner"),
        find(F.col(text)).alias("spans"),
    )
    return materialize(found, "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """``(value_hash, n_repositories, n_owners)`` of every candidate value of the corpus."""
    values = found.where(F.size("spans") > 0).select(
        "repository", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: F.md5(s["value"])))).alias("value_hash")
    )
    holders = values.groupBy("value_hash", "repository", "owner").agg(F.lit(1).alias("held"))
    by_owner = holders.groupBy("value_hash", "owner").agg(F.sum("held").alias("repositories"))
    return by_owner.groupBy("value_hash").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))


def verdicts(found: DataFrame, shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """One row per distinct text with candidates: ``(doc_id, text_hash, live, n_live, n_shared, most_owners, most_repositories)``.

    ``live`` lists ``(start, stop)`` of the values of spans that fewer than ``shared_owners`` owners and fewer than
    ``shared_repositories`` repositories hold.
    """
    owners = materialize(ownership(found), "owners")
    candidates = (
        found.where(F.size("spans") > 0)
        .dropDuplicates(["doc_id", "text_hash"])
        .select("doc_id", "text_hash", F.explode("spans").alias("span"))
        .select(
            "doc_id",
            "text_hash",
            (F.col("span.stop") - F.length("span.value")).alias("start"),
            F.col("span.stop").alias("stop"),
            F.md5(F.col("span.value")).alias("value_hash"),
        )
    )
    judged = materialize(candidates, "candidates").join(owners, "value_hash")
    live = (F.col("n_owners") < shared_owners) & (F.col("n_repositories") < shared_repositories)
    return judged.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.when(live, F.struct("start", "stop")))).alias("live"),
        F.sum(live.cast("long")).alias("n_live"),
        F.sum((~live).cast("long")).alias("n_shared"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repositories").alias("most_repositories"),
    )


def scan(
    docs: DataFrame, repository: Column, owner: Column, shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES
) -> DataFrame:
    """One row per document: its spans and the verdict on their values."""
    found = findings(docs, repository, owner)
    judged = verdicts(found, shared_owners, shared_repositories).withColumnRenamed("doc_id", "judged_id").withColumnRenamed("text_hash", "judged_hash")
    same = F.col("doc_id").eqNullSafe(F.col("judged_id")) & (F.col("text_hash") == F.col("judged_hash"))
    return found.join(judged, same, "left").drop("judged_id", "judged_hash")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span of the ascending ``(start, stop)`` list replaced by a mask; overlapping spans share one."""
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["pos"]
        kept = F.when(fresh, F.concat(F.substr(text, (state["pos"] + 1).cast("int"), (s["start"] - state["pos"]).cast("int")), F.lit(MASK)))
        return F.struct(
            F.greatest(state["pos"], s["stop"]).alias("pos"), F.concat(state["out"], F.coalesce(kept, F.lit(""))).alias("out")
        )

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, (s["pos"] + 1).cast("int"))))


def redact(
    docs: DataFrame, repository: Column, owner: Column, shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES
) -> DataFrame:
    """``docs`` with live-looking values masked and ``n_chars``, if there is one, set anew; all rows stay."""
    judged = verdicts(findings(docs, repository, owner), shared_owners, shared_repositories).where("n_live > 0")
    key, text_hash, live = spare(docs, "__id"), spare(docs, "__hash"), spare(docs, "__live")
    judged = judged.select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash), F.col("live").alias(live))
    hit = docs["doc_id"].eqNullSafe(judged[key]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == judged[text_hash])
    clean = F.when(F.col(live).isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col(live)))
    out = docs.join(judged, hit, "left").withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(live).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def owner_of(source: str = "source") -> Column:
    return F.col(source)


def repository_of(source: str = "source", part: str = "lang") -> Column:
    """The repositories of an owner: one per language."""
    return F.concat_ws("/", F.col(source), F.col(part))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, repository_of(), owner_of())
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *[count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_shared", F.lit(0)).alias("n_shared"),
        F.coalesce("most_owners", F.lit(0)).alias("most_owners"),
        F.coalesce("most_repositories", F.lit(0)).alias("most_repositories"),
    )
