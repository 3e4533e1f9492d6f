"""Periodic runs against a direct search over all periods, and the query's contract against its plain statement."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from commsim.llm import runs


def all_runs(words: list, least_length: int = 6, least_periods: int = 4) -> list[tuple[int, int, int]]:
    """Every longest stretch with smallest period ``p``, by comparing all words ``p`` apart."""
    found, n = {}, len(words)
    for p in range(1, n):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j - i + p), p)
            i = j
    return sorted((s, n, p) for (s, n), p in found.items() if n >= max(least_length, least_periods * p))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_words(rng: random.Random, n: int) -> list[bytes]:
    words: list[bytes] = []
    alphabet = [b"a", b"b", b"c", b"dd"][: rng.choice((1, 2, 3, 4))]
    while len(words) < n:
        unit = [rng.choice(alphabet) for _ in range(rng.randint(1, 7))]
        words += unit * rng.choice((1, 1, 2, 3, 4, 5, 9))
        words += [b"%d" % rng.randint(0, 50)] * rng.choice((0, 1, 2))
    return words[:n]


@pytest.mark.parametrize("least_length, least_periods", [(6, 4), (2, 2), (4, 3)])
def test_runs_equal_direct_search(least_length, least_periods):
    rng = random.Random(5)
    texts = [random_words(rng, rng.choice((0, 1, 2, 5, 9, 30, 80, 200))) for _ in range(250)]
    found = runs.runs_of_all(texts, least_length, least_periods)
    for words, got in zip(texts, found):
        expected = all_runs(words, least_length, least_periods)
        assert [tuple(r) for r in got.tolist()] == expected
        assert runs.kept_words(words, got) == collapsed(words, expected)


def test_extensions_and_orders_of_the_suffix_tree():
    rng = random.Random(11)
    for size in (1, 2, 3, 40, 300):
        text = [rng.randint(1, 2) for _ in range(size)]
        tree = runs.SuffixTree(text)
        suffixes = [text[i:] + [0] for i in range(size + 1)]
        assert tree.order == sorted(range(size + 1), key=suffixes.__getitem__)
        assert tree.opposite == sorted(range(size + 1), key=lambda i: [-s if s else -9 for s in suffixes[i]])
        pairs = [(i, j) for i in range(size + 1) for j in range(size + 1) if i != j]
        a, b = (np.array(x) for x in zip(*rng.sample(pairs, min(500, len(pairs)))))

        def common(i: int, j: int) -> int:
            n = 0
            while max(i, j) + n < size and text[i + n] == text[j + n]:
                n += 1
            return n

        assert tree.extension(a, b).tolist() == [common(i, j) for i, j in zip(a.tolist(), b.tolist())]


def test_words_of_a_run_are_never_cut_away():
    words = [b"x", b"a", b"a", b"a", b"a", b"a", b"a", b"y", b"b", b"c", b"b", b"c", b"b", b"c", b"b", b"c", b"z"]
    assert [tuple(r) for r in runs.runs_of_all([words])[0].tolist()] == [(1, 6, 1), (8, 8, 2)]


def test_a_long_text_of_one_word_and_one_without_repeats():
    found = runs.runs_of_all([[b"la"] * 30_000, [b"%d" % i for i in range(200_000)]])
    assert found[0].tolist() == [[0, 30_000, 1]] and not len(found[1])


def test_columns_of_the_input_stay(spark):
    rows = [(1, "a b " * 4 + "end", "r"), (None, None, "s"), (3, "", "t"), (1, "a b " * 4 + "end", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = runs.find_runs(docs)
    assert got.columns == ["doc_id", "text", "runs", "n_words", "runs_", "collapsed"]
    found = sorted(((r.doc_id or 0, r.runs, r.n_words, [tuple(x) for x in r.runs_], r.collapsed) for r in got.collect()))
    assert found == [(0, "s", 0, [], ""), (1, "r", 9, [(0, 8, 2)], "a b end"), (1, "r", 9, [(0, 8, 2)], "a b end"), (3, "t", 0, [], "")]
    with pytest.raises(ValueError):
        runs.periodic_runs(F.col("text"), least_periods=1)


def contract(doc_id: int, text: str | None) -> tuple:
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = all_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in found).encode()).hexdigest()
    rest = hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, digest, rest)


def test_query_against_its_contract(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, b" ".join(random_words(rng, rng.choice((0, 3, 40, 150)))).decode() + rng.choice(("", "\n", " é"))) for i in range(300)]
    rows += [(900, None), (901, "la " * 700), (902, "\t la\x0bla\x0cla la\r\nla la ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in runs.op11_runs(spark, str(tmp_path)).collect()}
    assert got == {i: contract(i, t) for i, t in rows}
