"""Registered queries do their whole job on tables that the tests build."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations_with_replacement, permutations

import pytest
from pyspark.sql import functions as F

from commsim.operators import pairs, text
from commsim.plans import pipelines, queries, tables

PARTS = ["teal gasket", "teal valve", "odd valve", "small gizmo", "hot gizmo"]


def parts(spark, folder) -> str:
    rows = [(k, name, "MEDIUM") for k, name in enumerate([*PARTS, PARTS[0], None])]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_common_substrings_of_every_pair_of_part_names(spark, tmp_path):
    got = {(r.s1, r.s2): r.lcs for r in queries.name_lcs(spark, parts(spark, tmp_path)).collect()}
    assert set(got) == set(permutations(PARTS, 2))
    assert got["teal gasket", "teal valve"] == "teal " and got["odd valve", "hot gizmo"] == " "


def test_affix_scores_of_every_pair_of_part_names(spark, tmp_path):
    folder = parts(spark, tmp_path)
    for query in (queries.affix_similarity, queries.affix_similarity_any):
        got = {(r.s1, r.s2): r.score for r in query(spark, folder).collect()}
        assert set(got) == set(permutations(PARTS, 2)) and set(got.values()) <= {0.0, 0.5, 1.0}


def test_scattered_features_are_not_turned_around(spark, monkeypatch):
    monkeypatch.setattr(pairs, "heavy_overlaps", None)
    monkeypatch.setattr(pairs, "BLOCK_PAIRS", 200)
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(700), 15)) for _ in range(40)] * 2 + [[63, 64, 699]]
    want = Counter(p for members in sets for p in combinations_with_replacement(members, 2))
    frame = spark.createDataFrame([(o, f) for f, members in enumerate(sets) for o in members] + [(5, None)], "ord long, f long")
    got = pairs.overlaps(frame, 700, "f").collect()
    assert len(got) == len(want) and {(r.i, r.j): r.common for r in got} == want


def test_pairs_are_counted_once_where_their_rows_meet(spark, monkeypatch):
    for name, value in (("MEAN_PAIRS", 900), ("PAIRS_PER_TASK", 40)):
        monkeypatch.setattr(pairs, name, value, raising=False)
    rng = random.Random(6)
    sets = [sorted({3, *rng.sample(range(900), 25)}) for _ in range(40)] + [[0, 3, 899]] * 70 + [[5]] * 3 + [list(range(90))]
    want = Counter(p for members in sets for p in combinations_with_replacement(members, 2))
    frame = spark.createDataFrame([(o, f) for f, members in enumerate(sets) for o in members] * 2 + [(5, None)], "ord long, f long")
    counts = pairs.overlaps(frame, 900, "f")
    assert "HashAggregate" not in counts._jdf.queryExecution().executedPlan().toString()
    got = counts.collect()
    assert len(got) == len(want) and {(r.i, r.j): r.common for r in got} == want
    assert pairs.overlaps(frame.where("f < 0"), 900, "f").count() == 0


def test_supplies_are_joined_once(spark, tmp_path):
    lines, orders = [(1, 7), (1, 7), (2, 8), (2, None), (9, 7), (None, 8)], [(1, 5), (2, 5), (3, 6), (None, 6)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    posts = tables.supplies(spark, str(tmp_path))
    assert "Join" not in posts._jdf.queryExecution().executedPlan().toString()
    assert Counter(map(tuple, posts.collect())) == Counter([("7", "5"), ("7", "5"), ("8", "5"), (None, "5")])
    assert [tuple(r) for r in queries.user_jaccard_sharing(spark, str(tmp_path)).collect()] == [("7", "8", 1, 1, 1, 1.0)]


def test_texts_are_dealt_before_their_grams_combine(spark, monkeypatch):
    monkeypatch.setattr(text, "SPLIT_BYTES", 1000)
    posts = spark.createDataFrame([(f"s{k % 3}" if k % 4 else None, f"alpha w{k} beta gamma") for k in range(200)], "subreddit string, title string").coalesce(1)
    grams = text.ngram_occurrences(posts, "subreddit")
    assert grams.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
    want = {(f"s{k % 3}" if k % 4 else None, g) for k in range(200) for g in (f"alpha w{k}", f"w{k} beta", "beta gamma")}
    rows = pipelines.posts_to_edges(posts).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    place = {g: i for i, g in enumerate(sorted({g for _, g in want}))}
    rows = pipelines.posts_to_components(posts).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == {(c, place[g]) for c, g in want}


def one_file_of_texts(spark, folder) -> str:
    texts = [(k, f"alpha w{k % 50} beta gamma" if k % 9 else None, f"src{k % 3}" if k % 7 else None) for k in [*range(200), 8, 8]]
    posts = [(k, k % 11, "view" if k % 5 else "error", f"k{k % 200}") for k in range(300)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(posts, "event_id long, user_id long, event_type string, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def counted_tasks(monkeypatch) -> list[int]:
    """The tasks that hold the texts of each call of ``ngram_rows`` from now on."""
    rows, tasks = text.ngram_rows, []

    def counted(posts, *keys, **options):
        tasks.append(posts.select(F.spark_partition_id().alias("p")).distinct().count())
        return rows(posts, *keys, **options)

    monkeypatch.setattr(text, "ngram_rows", counted)
    return tasks


@pytest.mark.parametrize("name", ["text_scores", "ngram_index", "ngram_vocab"])
def test_query_deals_its_texts(spark, tmp_path, monkeypatch, name):
    folder, tasks = one_file_of_texts(spark, tmp_path), counted_tasks(monkeypatch)
    want = sorted(queries.queries()[name](spark, folder).collect())
    monkeypatch.setattr(text, "SPLIT_BYTES", 500)
    assert want and sorted(queries.queries()[name](spark, folder).collect()) == want
    assert tasks[0] == 1 and tasks[-1] >= 4


def test_fusions_deal_their_texts(spark, tmp_path, monkeypatch):
    folder, tasks = one_file_of_texts(spark, tmp_path), counted_tasks(monkeypatch)
    monkeypatch.setattr(text, "SPLIT_BYTES", 500)
    scores = sorted(queries.fuse_scores(spark, folder).collect())
    assert scores and sorted(queries.fuse_score_files(spark, folder).collect()) == scores
    assert len(tasks) == 2 and min(tasks) >= 4


def test_intersection_combines_repeats_before_its_shuffle(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "g string") for xs in (["x", "x", "y", None], ["x", "z", None, None]))
    both = pairs.set_intersect(a, b)
    assert sorted((r.g or "" for r in both.collect())) == ["", "x"]
    assert "Join" not in both._jdf.queryExecution().executedPlan().toString()
