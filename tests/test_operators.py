"""Worked examples and properties of the library's operators."""

from __future__ import annotations

import json
import math
import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from commsim import session, sources
from commsim.functions import text as text_fn
from commsim.operators import baskets, filters, fuse, index, meta, names, pairs, suffixes
from commsim.operators import text as text_ops
from commsim.plans import pipelines


def listed(spark, values):
    return pairs.community_index(spark.createDataFrame(list(enumerate(values)), "place int, name string"), "name", order="place")


def edges(spark, rows, *columns):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


@pytest.mark.parametrize(
    "title, tokens",
    [
        ("Hello world Foo? Bar!!!abc.d", ["hello", "world", "foo", "bar", "abc"]),
        ("a", []),
        ("a ", ["a"]),
        ("a b", ["a"]),
        ("abc d ", ["abc", "d"]),
        ("ab", ["ab"]),
        ("", []),
    ],
)
def test_tokens(spark, title, tokens):
    assert spark.createDataFrame([(title,)], "t string").select(text_fn.tokens(F.col("t"), False)).first()[0] == tokens


def test_ngrams_of_two_and_three(spark):
    posts = spark.createDataFrame([("s", "foo bar baz"), ("s", "foo"), ("s", "x"), ("s", None)], "subreddit string, title string")
    for n, want in ((2, ["bar baz", "foo", "foo bar"]), (3, ["foo", "foo bar baz"])):
        assert sorted(r.ngram for r in text_ops.ngram_occurrences(posts, "subreddit", n=n).collect()) == want


def baskets_of(spark):
    rows = [(f"u{i}", c) for i, group in enumerate(("abc", "abde", "ace", "acf")) for c in group]
    return edges(spark, rows, "author", "subreddit")


def test_toy_baskets(spark):
    posts = baskets_of(spark)
    listed_items = listed(spark, "abcdef")
    counts = {r.item: r.freq for r in baskets.item_counts(posts).collect()}
    assert counts == {"a": 4, "b": 2, "c": 3, "d": 1, "e": 2, "f": 1}
    found = pipelines.user_pairs(posts, listed_items)
    scores = {(r.s1, r.s2): r.score for r in baskets.user_cosine(found).collect()}
    assert scores["a", "b"] == pytest.approx(2 / math.sqrt(8)) and scores["b", "c"] == pytest.approx(1 / math.sqrt(6))
    supported = {(r.s1, r.s2): r.freq for r in pipelines.user_pairs(posts, listed_items, support=2).collect()}
    assert supported == {("a", "b"): 2, ("a", "c"): 3, ("a", "e"): 2}


def test_allow_list_bounds_baskets(spark):
    allowed = session.materialize(spark.createDataFrame([("a",), ("c",)], "name string"), "allowed")
    lists = baskets.author_baskets(baskets.author_edges(baskets_of(spark), allowed=allowed))
    assert {r.author: r.communities for r in lists.collect()} == {"u0": ["a", "c"], "u1": ["a"], "u2": ["a", "c"], "u3": ["a", "c"]}


def test_excluded_author_is_subtracted(spark):
    rows = [("x", "a"), ("x", "b"), ("[deleted]", "a"), ("[deleted]", "b"), ("[deleted]", "c"), ("y", "c"), ("y", "a")]
    posts, given = edges(spark, rows, "author", "subreddit"), listed(spark, "cab")
    less = pipelines.without_author(pipelines.author_overlaps(posts, given), posts, given, "[deleted]")
    direct = pipelines.author_overlaps(posts, given, "[deleted]")
    assert sorted(map(tuple, less.collect())) == sorted(map(tuple, direct.collect()))


def common(first: str, second: str) -> str:
    best = (0, 0, 0, "")
    for start in range(len(second)):
        for end in range(start + 1, len(second) + 1):
            at = first.find(second[start:end], start)
            if at >= 0:
                best = max(best, (end - start, start - at, -start, second[start:end]))
    return best[3]


def test_longest_common_substrings(spark):
    words = ["xabc", "abc", "worldnews", "news", "aab", "baa", "", "zz", "abcabc"]
    got = {(r.s1, r.s2): r.lcs for r in names.name_lcs(listed(spark, words)).collect()}
    assert got["xabc", "abc"] == "abc" and got["abc", "xabc"] == "" and got["worldnews", "news"] == "news" and got["news", "worldnews"] == "w"
    assert got == {(a, b): common(a, b) for a, b in permutations(words, 2)}


@pytest.mark.parametrize("min_length", [1, 4])
def test_branching_substrings_over_many_ranges(spark, min_length):
    rng = random.Random(7)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) + rng.choice(["", "news", "new"]) for _ in range(120)] + ["aaaa"] * 3
    rows = [(i, w) for i, w in enumerate(words)]
    places: dict[str, list] = {}
    for i, w in rows:
        for s in range(len(w)):
            for e in range(s + min_length, len(w) + 1):
                places.setdefault(w[s:e], []).append((i, s, w[s - 1 : s] if s else "", w[e : e + 1]))
    want = {(i, s, sub, b) for sub, ps in places.items() if len(ps) > 1 and (len({p[3] for p in ps}) > 1 or "" in {p[3] for p in ps}) for i, s, b, _ in ps}
    frame = spark.createDataFrame(rows, "ord long, name string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = suffixes.branching_substrings(frame, F.col("name"), "ord", min_length=min_length).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert suffixes.branching_substrings(frame.limit(0), F.col("name"), "ord").count() == 0


def test_requested_pairs_of_names(spark):
    given = listed(spark, ["xabc", "abc", "worldnews", "news"])
    wanted = pairs.directed_pairs(given).where("(s1 = 'xabc' AND s2 = 'abc') OR (s1 = 'news' AND s2 = 'worldnews')")
    assert sorted(map(tuple, names.name_lcs(given, wanted).collect())) == [("news", "worldnews", "w"), ("xabc", "abc", "abc")]


def test_mining_counts_every_ordered_pair(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(4, 14))) + rng.choice(["pics", "porn", "news"]) for _ in range(90)})
    candidates = sorted({c for a, b in permutations(words, 2) if len(c := common(a, b)) >= 4})
    want: dict[str, int] = {}
    for a, b in permutations(candidates, 2):
        c = common(a, b)
        if len(c) >= 4 and c in candidates:
            want[c] = want.get(c, 0) + 1
    mined = names.mine_affixes(spark.createDataFrame([(w,) for w in words], "name string"))
    assert {r.affix: r.freq for r in mined.collect()} == want


def test_tagging_ignores_case_on_request(spark):
    listed_names = spark.createDataFrame([("AskNews",), ("newspics",), ("other",)], "name string")
    affixes = session.materialize(spark.createDataFrame([("news",), ("pics",)], "affix string"), "affixes")
    tagged = lambda **kw: {r.name: r.affixes for r in names.tag_affixes(listed_names, affixes, **kw).collect()}
    assert tagged() == {"AskNews": "", "newspics": "news|pics", "other": ""}
    assert tagged(ignore_case=True) == {"AskNews": "news", "newspics": "news|pics", "other": ""}


def directed(frame, value):
    return {(r.s1, r.s2): r[value] for r in frame.collect() if r[value]}


def test_moderators(spark):
    given = listed(spark, ["p", "q", "r", "s", "t"])
    mods = edges(spark, [("p", "m1"), ("p", "m2"), ("q", "m1"), ("r", "m2"), ("r", "m1"), ("p", "m1")], "name", "mod")
    score = lambda **kw: directed(meta.on_pairs(given, meta.moderator_scores(mods, given, **kw)), "moderator")
    assert score() == {("p", "q"): 0.5, ("r", "q"): 0.5, ("s", "t"): 1.0, ("t", "s"): 1.0}
    assert score(set_overlap=True) == {
        ("p", "q"): 0.5, ("p", "r"): 1.0, ("q", "p"): 1.0, ("q", "r"): 1.0, ("r", "p"): 1.0, ("r", "q"): 0.5, ("s", "t"): 1.0, ("t", "s"): 1.0,
    }


def test_mentions_of_names_and_of_single_characters(spark):
    given = listed(spark, ["News", "pics", "x"])
    said = edges(spark, [("News", "PICS"), ("News", "z"), ("pics", "a"), ("pics", "News"), ("x", "bza")], "name", "mention")
    scores = directed(meta.on_pairs(given, meta.mention_scores(said, given)), "mention")
    # The last matching mention in list order decides: "z" stands in the mentions of x, "a" in those of x.
    assert scores == {("News", "pics"): 1.0, ("News", "x"): 0.5, ("pics", "x"): 0.5, ("pics", "News"): 1.0}
    shared = edges(spark, [("News", "both"), ("pics", "Both"), ("x", "news")], "name", "mention")
    common_scores = directed(meta.on_pairs(given, meta.mention_scores(shared, given, co_mention=True)), "mention")
    assert common_scores == {("News", "pics"): 0.5, ("pics", "News"): 0.5, ("x", "News"): 1.0}


def test_affix_and_dictionary_scores(spark):
    given = listed(spark, ["askhistory", "history", "askart", "tory"])
    affixes = edges(spark, [("askhistory", "askh"), ("askhistory", "hist"), ("history", "hist"), ("askart", "ask")], "name", "affix")
    words = session.materialize(spark.createDataFrame([("ask",), ("tory",)], "word string"), "words")
    want, listing = {}, ["askhistory", "history", "askart", "tory"]
    own = {"askhistory": "hist", "history": "hist", "askart": "ask"}
    for target, other in permutations(listing, 2):
        hit = len(own.get(target, "")) > 3 and own[target] in other
        score = 1.0 if hit else 0.5 if common(other, target) in ("ask", "tory") else 0.0
        want |= {(target, other): score} if score else {}
    assert directed(meta.on_pairs(given, meta.affix_scores(affixes, given, words)), "affix") == want and 0.5 in want.values()


def test_fusion_takes_the_later_direction_in_list_order(spark):
    order = ["IAmA", "AskReddit"]
    text = spark.createDataFrame([("IAmA", "AskReddit", 0.12432769400053274, 0.0828923045256087, 0)], "s1 string, s2 string, ngram double, user double, ord int")
    user = spark.createDataFrame([], "s1 string, s2 string, score double, ord int")
    both = spark.createDataFrame([("IAmA", "AskReddit", 0.6, 1), ("AskReddit", "IAmA", 0.0, 0)], "s1 string, s2 string, score double, ord int")
    row = fuse.fuse(listed(spark, order), text, user, both).first()
    assert (row.s1, row.s2) == ("IAmA", "AskReddit") and row.text == pytest.approx(0.062165999557842425) and row.meta == pytest.approx(0.06)
    row = fuse.fuse(listed(spark, order), text, user, both.withColumn("ord", -F.col("ord"))).first()
    assert row.meta == 0.0 and row.total == pytest.approx(row.text)


def test_pipeline_takes_the_target_that_stands_behind(spark):
    order = ["zeta", "alpha", "mid"]
    posts = edges(spark, [("alpha", "one two", "u"), ("zeta", "one two three", "u"), ("mid", "four five", "v")], "subreddit", "title", "author")
    said = edges(spark, [("alpha", "zeta"), ("zeta", "mid")], "name", "mention")
    none = edges(spark, [], "name", "affix")
    mods = edges(spark, [(n, n) for n in order], "name", "mod")
    words = session.materialize(spark.createDataFrame([("q",)], "word string"), "words")
    rows = pipelines.fused_scores(posts, posts, none, mods, said, words, listed(spark, order)).collect()
    got = {(r.s1, r.s2): (round(r.text, 6), round(r.user, 6), round(r.meta, 6)) for r in rows}
    assert got == {("zeta", "alpha"): (0.45, 0.3, 0.06), ("zeta", "mid"): (0.0, 0.0, 0.0), ("alpha", "mid"): (0.0, 0.0, 0.0)}


def test_score_files_with_one_array(spark, tmp_path):
    rows = [{"s1": "a", "s2": "b", "ngram": 0.5, "user": 0.25}, {"s1": "b", "s2": "c", "ngram": 0.1, "user": 0.0}]
    (tmp_path / "scores.json").write_text(json.dumps([*rows, {**rows[0], "ngram": 0.9}], indent=4))
    text = sources.read_score_arrays(spark, str(tmp_path / "scores.json"), sources.TEXT_SCORES)
    other = spark.createDataFrame([], "s1 string, s2 string, score double, ord int")
    fused = {(r.s1, r.s2): r.total for r in fuse.fuse(listed(spark, "cba"), text, other, other).collect()}
    assert fused == {("b", "a"): pytest.approx(0.225), ("c", "b"): pytest.approx(0.03), ("c", "a"): 0.0}


@pytest.mark.parametrize("n", [0, 1, 50])
def test_score_arrays_keep_their_order(spark, tmp_path, n):
    rows = [(i, f'"{i},\n', "é", i / 7) for i in range(n)]
    frame = spark.createDataFrame(rows, "i long, s1 string, s2 string, score double").repartition(5)
    sources.write_score_array(frame, f"{tmp_path}/out", "i")
    (file,) = tmp_path.glob("out/part-*")
    assert json.loads(file.read_text()) == [{"s1": a, "s2": b, "score": s} for _, a, b, s in rows]
    got = sources.read_score_arrays(spark, f"{tmp_path}/out").orderBy("ord").collect()
    assert [(r.ord, r.s1, r.s2, r.score) for r in got] == rows


def test_first_lines_of_the_metadata_file(spark, tmp_path):
    metadata = spark.createDataFrame([("z", "", "é", "", 0), ("y", "a|b", "", "", 1), ("a", "", "", "", 2)], "name string, affixes string, mods string, mentions string, place long")
    sources.write_metadata(metadata, f"{tmp_path}/meta", order="place")
    rows = meta.first_rows(sources.read_metadata(spark, f"{tmp_path}/meta", placed=True), 2).collect()
    assert {r.name: (r.affixes, r.mods) for r in rows} == {"z": ("", ""), "y": ("a|b", "")}
    assert {tuple(r) for r in meta.list_edges(metadata, "affixes", "affix").collect()} == {("y", "a"), ("y", "b")}


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    rng = random.Random(3)
    lines = [f"n{i},{'x' * rng.randint(0, 60)},m,r" for i in range(700)]
    for k, (low, high) in enumerate(((0, 300), (300, 301), (301, 301), (301, 700))):
        (tmp_path / f"part-{k}.csv").write_text("".join(f"{line}\n" for line in lines[low:high]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("997", size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        placed = sources.read_metadata(spark, str(tmp_path), placed=True)
        assert [r.name for r in placed.orderBy("place").collect()] == [f"n{i}" for i in range(700)]
        assert sorted(r.place for r in placed.collect()) == list(range(700))
        assert [r.name for r in meta.first_rows(placed, 305).orderBy(F.substring("name", 2, 9).cast("int")).collect()] == [f"n{i}" for i in range(305)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_itemsets_equal_brute_force(spark):
    rng = random.Random(6)
    held = {f"u{i}": {c for k, c in enumerate("abcdefghij") if rng.random() < 0.9 - 0.08 * k} for i in range(60)}
    rows = [(u, c) for u, cs in held.items() for c in cs]
    for support, size in ((20, 4), (12, 5), (61, 3), (1, 2), (30, 1)):
        want = {}
        for k in range(1, size + 1):
            for items in combinations("abcdefghij", k):
                n = sum(set(items) <= cs for cs in held.values())
                want |= {items: n} if n >= support else {}
        got = {tuple(r["items"]): r.freq for r in baskets.frequent_itemsets(edges(spark, rows, "author", "subreddit"), support, size).collect()}
        assert got == want
    with pytest.raises(ValueError):
        baskets.frequent_itemsets(edges(spark, rows, "author", "subreddit"), 0, 3)


def test_candidates_have_frequent_subsets_only(spark):
    sets = [[0, 1], [0, 2], [1, 2], [0, 3], [1, 3], [2, 4]]
    frequent = session.materialize(spark.createDataFrame([(s,) for s in sets], "items array<long>"), "sets")
    assert [tuple(r["items"]) for r in baskets.candidate_sets(frequent, 3).orderBy("items").collect()] == [(0, 1, 2), (0, 1, 3)]


@pytest.mark.parametrize("heavy_tiles", [0, 1, 2, 8])
def test_features_in_many_tiles(spark, heavy_tiles):
    rng = random.Random(9)
    rows = [(o, f) for f in range(90) for o in rng.sample(range(200), rng.choice((1, 2, 5, 150)))]
    sets: dict[int, set] = {}
    for o, f in rows:
        sets.setdefault(o, set()).add(f)
    want = {(i, j): n for i in sets for j in sets if i <= j and (n := len(sets[i] & sets[j]))}
    frame = spark.createDataFrame([*rows, *rows[:50], (3, None)], "ord long, f long")
    got = pairs.overlaps(frame, 200, "f", heavy_tiles).collect()
    assert len(got) == len(want) and {(r.i, r.j): r.common for r in got} == want


@pytest.mark.parametrize("communities", [30, 150, 700])
def test_overlaps_of_a_support(spark, communities):
    rng = random.Random(4)
    rows = [(o, f) for o in range(communities) for f in rng.sample(range(60), rng.choice((0, 1, 3, 20)) if o % 9 else 40)]
    sets: dict[int, set] = {}
    for o, f in rows:
        sets.setdefault(o, set()).add(f)
    frame = spark.createDataFrame([*rows, *rows[:50], (3, None)], "ord long, f long")
    for support in (1.5, 15, 30, 61):
        want = {(i, j): n for i in sets for j in sets if i <= j and (n := len(sets[i] & sets[j])) >= support}
        got = pairs.supported_overlaps(frame, "f", support).collect()
        assert len(got) == len(want) and {(r.i, r.j): r.common for r in got} == want


def test_groups_below_the_support_are_not_counted(spark):
    rows = [(o, o * 100 + f) for o in range(64) for f in range(5)] + [(o, -f) for o in (3, 40) for f in range(1, 10)]
    frame = spark.createDataFrame(rows, "ord long, f long")
    every = pairs.overlaps(frame, 64, "f")
    among = session.materialize(spark.createDataFrame([(0, 5)], "g long, h long"), "groups")
    assert every.count() == 65
    assert [(r.i, r.j, r.common) for r in pairs.overlaps(frame, 64, "f", among=among).collect()] == [(3, 40, 9)]


def test_blocks_as_ml_vectors(spark):
    parts = spark.createDataFrame([("a", i) for i in (0, 3, 4, 9)] + [("b", 5)], "subreddit string, index long")
    rows = index.ml_vectors(index.community_vectors(parts, 10, 4), 10, 4).collect()
    assert {(r.subreddit, r.block, r.length, r.vector.size, tuple(r.vector.indices), tuple(r.vector.values)) for r in rows} == {
        ("a", 0, 4, 4, (0, 3), (1.0, 1.0)), ("a", 1, 4, 4, (0,), (1.0,)), ("a", 2, 2, 4, (1,), (1.0,)), ("b", 1, 4, 4, (1,), (1.0,)),
    }


def test_jaccard_of_given_and_of_sharing_pairs(spark):
    rng = random.Random(2)
    sets = {f"c{i}": {str(rng.randint(0, 60)) for _ in range(rng.randint(1, 9))} for i in range(80)}
    rows = [(c, f) for c, fs in sets.items() for f in fs] * 2
    given = listed(spark, sorted(sets, reverse=True))
    counts = pairs.pair_overlaps(edges(spark, rows, "subreddit", "f"), given, "f")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets, reverse=True), 2)}
    assert {(r.s1, r.s2): pytest.approx(r.jaccard) for r in pairs.jaccard(counts, given).collect()} == want
    sharing = {(r.s1, r.s2): pytest.approx(r.jaccard) for r in pairs.sharing_jaccard(counts, given).collect()}
    assert sharing == {k: v for k, v in want.items() if v}


def test_vector_blocks(spark):
    parts = spark.createDataFrame([("a", i) for i in (0, 3, 4, 9)] + [("b", 5)], "subreddit string, index long")
    blocks = index.dense_blocks(index.community_vectors(parts, 10, 4), 10, 4).collect()
    assert {(r.subreddit, r.block, r.length, tuple(r.local)) for r in blocks} == {("a", 0, 4, (0, 3)), ("a", 1, 4, (0,)), ("a", 2, 2, (1,)), ("b", 1, 4, (1,))}


def test_dense_ids_keep_value_order(spark):
    values = [f"v{i * 7 % 1000:04d}" for i in range(1000)]
    numbered = index.dense_index(spark.createDataFrame([(v,) for v in values * 2], "v string").repartition(7), "v")
    assert numbered.size == 1000 and {r.v: r["index"] for r in numbered.frame.collect()} == {v: i for i, v in enumerate(sorted(set(values)))}


def test_wide_arrays_are_not_broadcast(spark):
    wide = spark.range(4).select("id", F.array_repeat(F.repeat(F.lit("x"), 1000), 100).alias("texts"))
    assert not session.fits_broadcast(wide, 200_000) and session.fits_broadcast(wide, 1_000_000)
    assert session.fits_broadcast(wide.limit(0), 1)


def test_intermediates_stay_in_the_shared_folder(spark):
    folder = session.run_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = session.materialize(spark.range(5), "numbers")
    assert kept.count() == 5 and all(f.startswith("file:" + folder) or folder in f for f in kept.inputFiles())


def test_filters(spark):
    frame = edges(spark, [("a", "1"), ("A", "2"), (None, "3")], "k", "v")
    assert [r.v for r in filters.in_values(frame, "k", ["a"]).collect()] == ["1"]
    assert [r.v for r in filters.in_joined_values(frame, "k", "A,b").collect()] == ["2"]
    assert [r.v for r in filters.not_value(frame, "k", "a").collect()] == ["2"]
