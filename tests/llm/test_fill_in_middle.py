"""Fill-in-middle: cuts against plain slicing, exact round trips, and the query beside its SQL."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from commsim.llm import fill_in_middle as fim


def test_offsets_are_sums_of_widths():
    rng = np.random.default_rng(1)
    for n in (0, 1, 15, 16, 17, 255, 256, 257, 5000):
        widths = rng.integers(0, 9, n)
        lanes = fim.SkipList(widths)
        sums = np.concatenate(([0], np.cumsum(widths)))
        assert [lanes.offset(r) for r in range(n + 1)] == sums.tolist()


def test_units_cover_the_text():
    words = re.compile(r"\S+")
    for text in ("", "  ", "one", "  one two\n three  ", "é ü\U0001f600 x"):
        widths = fim.unit_widths(text, words)
        assert widths.sum() == len(text) and len(widths) == max(len(text.split()), 1 if text else 0)
    assert fim.unit_widths("é\U0001f600", None).tolist() == [1, 1, 1]


def expected(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return text, "plain", None, None
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h[3] % 100 < 20:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", "spm", low, high - low
    return f"<P>{prefix}<S>{suffix}<M>{middle}", "psm", low, high - low


def some_rows() -> list[tuple]:
    rng = random.Random(2)
    signs = "ab <>PSM\né\U0001f600́"
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.choice((0, 1, 2, 20, 400))))) for i in range(250)]
    return [*rows, (None, None), (None, "null id"), (7, None), (8, "<P"), (9, "x" * 200_000), (10, "a <S> b"), (3, rows[3][1])]


def test_outputs_and_round_trip(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("kept"))
    made = fim.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "form", "form_", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form_"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"kept"} and {r.form_ for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.output, r.form_, r.prefix_chars, r.middle_chars) == expected(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_cuts_at_words(spark):
    docs = spark.createDataFrame([(i, f"one  two three é{i} five") for i in range(60)], "doc_id long, text string")
    for r in fim.fill_in_middle(docs, unit=r"\S+", transformed=100).collect():
        for place in (r.prefix_chars, r.prefix_chars + r.middle_chars):
            assert place in (0, len(r.text)) or (r.text[place - 1] == " " and r.text[place] != " ")


def test_query_beside_its_sql(spark, tmp_path):
    spark.createDataFrame(some_rows(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = fim.op12_fill_in_middle(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        answer = db.execute(fim.ORACLE)
        assert [c[0] for c in answer.description] == found.columns
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, answer.fetchall()))
