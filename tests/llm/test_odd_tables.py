"""All operator queries and the pipeline on empty tables, and on null, repeated and empty rows beside columns with clashing names."""

from __future__ import annotations

import pytest

import corpus_pipeline
from commsim.llm import registry

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
OTHERS = {
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
LONG = "some words of a long text " * 2000
ITEM = "which of these rivers has its source beside the old stone garden wall"
ROWS = {
    "documents": [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, "en", "a", None)]
    + [(3, LONG, None, "b", len(LONG)), (4, LONG, "de", None, len(LONG)), (5, f"One asks {ITEM} today", "en", "b", 80)]
    + [(6, "mail a@b.org and password = hunter22", "en", "a", 36)],
    "labels": [(None, None, None), (3, 0, 1), (77, 1, None), *[(i, 1, 0) for i in (1, 2, 3, 4, 5, 6)]],
    "benchmark": [(None, None), (1, ITEM), (1, ITEM), (2, None), (3, "")],
    "pages": [(None, None, None), (1, "", ""), (1, "", ""), (2, "http://x.org/a", "<p>one &amp; two</p>")],
    "embeddings": [(None, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, 0.0], None)]
    + [(6, [1.0, 0.0], 1), (6, [1.0, 0.0], 1), (7, [2.0, 0.0], 1), (8, [float("nan"), 1.0], 1)],
}
CLASHING = ["key", "hash", "row", "print", "component", "spans", "value_hash", "score", "slot", "host", "rep", "__id", "__dropped", "__toxicity"]


def folder(spark, path, rows: dict, extra: list[str]) -> str:
    for name, schema in {"documents": DOCUMENTS, **OTHERS}.items():
        frame = spark.createDataFrame(rows.get(name, []), schema)
        frame.selectExpr("*", *[f"'x' AS `{c}`" for c in extra]).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), {}, [])


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("odd"), ROWS, CLASHING)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", list(registry.queries()))
def test_odd_rows_each_have_a_result(spark, odd, name):
    found = registry.queries()[name](spark, odd).collect()
    if name == "op3_decontamination":
        assert [(r.doc_id, r.item_id, r.distance) for r in found] == [(5, 1, 0)] * 2
    else:
        table = {"op2_embeddings": "embeddings", "op6_html": "pages"}.get(name, "documents")
        if name == "op13_packing":
            found = [r for r in found if not r.piece]  # long texts have several pieces
        key = {"embeddings": "vec_id", "pages": "page_id"}.get(table, "doc_id")
        assert sorted((r[key] is None, r[key] or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in ROWS[table])


def test_pipeline_on_empty_and_odd_tables(spark, empty, odd):
    assert corpus_pipeline.run(spark, empty).count() == 0
    kept = [r.doc_id for r in corpus_pipeline.run(spark, odd).collect()]
    assert kept.count(None) == 1 and kept.count(1) == 2 and set(kept) == {None, 1, 3, 6}
