"""Near-duplicates and repeats against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from commsim.llm import embeddings, simhash, substrings
from commsim.llm.components import components


def smallest_reachable(nodes, links) -> dict:
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    edges += edges[:10] + [(7, 7)]
    frame = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: c for n, c in smallest_reachable({n for e in edges for n in e}, edges).items() if n in nodes}
    assert components(frame.limit(0)).count() == 0


def print_of(text: str | None) -> int:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    texts = [None, "", " \n", "One", "ONE two", "É É\x85x a b", "a b c d a b c d", "x " * 70_000, "w1 w2 w3 w4 w5 w6"]
    for t in texts:
        assert simhash.fingerprint_of(t) & (1 << 64) - 1 == print_of(t)


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 300, np.int64).astype(np.uint64)
    values[100:200] = values[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    values[200:] = values[100:200] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    for radius in range(5):
        q, v = simhash.near(values, values, radius)
        far = np.bitwise_count(values[:, None] ^ values[None, :])
        assert set(zip(q.tolist(), v.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= radius))))


def test_links_connect_exactly(spark):
    rng = random.Random(2)
    prints = {0}
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            prints.add(base)
            base ^= 1 << rng.randint(0, 63) | 1 << rng.randint(0, 63)
    prints = sorted(prints)
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    frame = spark.createDataFrame(signed, "id long, print long")
    pairs = [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if i < j and (a ^ b).bit_count() <= 2]
    want = {n: c for n, c in smallest_reachable(range(len(prints)), pairs).items() if any(n in p for p in pairs)}
    for chunk in (simhash.CHUNK, 2):  # the second cuts every bucket
        assert {r.node: r.component for r in components(simhash.links(frame, chunk=chunk)).collect()} == want


def test_simhash_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, long), (3, long + " x"), (9, None), (4, ""), (8, "other words here"), (8, "other words here"), (None, long), (7, "OTHER words\nhere")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit(1)).withColumn("component", F.lit(1))
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    close = (print_of(long) ^ print_of(long + " x")).bit_count() <= 2
    assert sorted(got, key=str) == sorted([(5, 3 if close else 5), (3, 3), (9, 4), (4, 4), (8, 7), (8, 7), (None, None), (7, 7)], key=str)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [3, 4, 7] + ([] if close else [5])
    assert kept.where("doc_id IS NULL").count() == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    vectors = [centres[i % 12] + rng.standard_normal(16) * (0.02 if i % 3 else 0.6) for i in range(400)]
    vectors[10:40] = [vectors[7]] * 30
    vectors[50] = vectors[7] * 1e200
    labels = [int(i % 5 == 0) for i in range(400)]
    labels[7:41] = [1] * 34
    labels[50] = 1
    rows = [(i, [float(x) for x in v], lab) for i, (v, lab) in enumerate(zip(vectors, labels))]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [None] * 16, 1), (1005, rows[7][1], None), (1006, rows[7][1][:8], 1), (1007, [float("inf")] * 16, 1)]
    frame = spark.createDataFrame([*rows, *odd, (None, rows[7][1], 1), rows[3]], "vec_id long, embedding array<double>, label int")
    frame = frame.withColumn("rep", F.lit(1)).withColumn("links", F.lit(1)).withColumn("component", F.lit(0))
    unit = np.array([v / np.abs(v).max() for v in vectors])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    low = smallest_reachable(range(400), list(zip(*(x.tolist() for x in np.nonzero(near)))))
    old = embeddings.CHUNK
    got = [tuple(r) for r in embeddings.near_duplicates(frame).collect()]
    want = [(i, int(near[i].sum()), low[i], low[i] == i) for i in range(400)]
    want += [want[3], *((i, 0, i, True) for i, *_ in odd), (None, 0, None, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert embeddings.CHUNK == old and embeddings.near_duplicates(frame.limit(0)).count() == 0
    reps = spark.createDataFrame([(i, 0, 1, [float(x) for x in unit[i]]) for i in range(60)], "rep long, component long, copies long, embedding array<double>")
    counted = {r.rep: r.links for r in embeddings.exact_counts(reps, chunk=7).collect()}
    inside = unit[:60] @ unit[:60].T >= 0.98
    assert counted == {i: int(inside[i].sum()) - 1 for i in range(60)}


def cloud(seed, n, planted, dims=64, cosine=0.95):
    """``n`` vectors at about ``cosine`` to each other and ``planted`` partners at 0.981 to the first of them."""
    rng = np.random.default_rng(seed)
    around = rng.standard_normal((n, dims))
    around /= np.linalg.norm(around, axis=1)[:, None]
    centre = np.eye(dims)[0]
    around[:, 0] = 0
    around /= np.linalg.norm(around, axis=1)[:, None]
    unit = np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * around
    side = rng.standard_normal((planted, dims))
    side -= np.einsum("ij,ij->i", side, unit[:planted])[:, None] * unit[:planted]
    side /= np.linalg.norm(side, axis=1)[:, None]
    return np.concatenate((unit, 0.981 * unit[:planted] + np.sqrt(1 - 0.981**2) * side))


@pytest.mark.parametrize("chunk", [1024, 64])
def test_embeddings_in_a_dense_cloud(spark, monkeypatch, chunk):
    """All planted links are found among thousands that nearly link, and beside a group of copies larger than a chunk."""
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    n = 3000 if chunk == 1024 else 700
    unit = cloud(8, n, 100)
    copies = unit[n // 2] + np.random.default_rng(9).standard_normal((150, 64)) * 0.002  # one component, in the cloud's buckets
    unit = np.concatenate((unit, copies / np.linalg.norm(copies, axis=1)[:, None]))
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    low = smallest_reachable(range(len(unit)), list(zip(*(x.tolist() for x in np.nonzero(near)))))
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(unit)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(frame).collect()}
    assert got == {i: (int(near[i].sum()), low[i]) for i in range(len(unit))}
    reps = spark.createDataFrame([(i, 1, 64, v.tolist()) for i, v in enumerate(unit)], "rep long, label int, dim int, embedding array<double>")
    passes = embeddings.Passes(reps)
    joined = spark.createDataFrame([(i, n + 100) for i in range(n + 100, len(unit))], "rep long, component long")
    crossing = {(r.a, r.b) for r in passes.block_links(joined).collect()}
    of = [min(i, n + 100) for i in range(len(unit))]
    real = {(of[i], of[j]) for i, j in zip(*(x.tolist() for x in np.nonzero(near))) if of[i] < of[j]}
    assert crossing <= real and len(crossing) >= 0.9 * len(real)  # windows alone see the small buckets


def repeats(docs, length):
    first = {}
    for doc_id, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        words = substrings.words_of(text)
        for p in range(len(words) - length + 1):
            first.setdefault(tuple(words[p : p + length]), doc_id)
    out = []
    for doc_id, text in docs:
        words = substrings.words_of(text)
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            if doc_id is not None and first[tuple(words[p : p + length])] < doc_id:
                gone[p : p + length] = [True] * length
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_windows_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["a", "b", "c", "É", "x y", "A"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [line(n) for n in (49, 50, 51, 120, 400)]
    docs = [(i, "\t".join([line(rng.randint(0, 60)), rng.choice(passages), line(rng.randint(0, 90))])) for i in range(60)]
    docs += [(100, docs[5][1]), (101, docs[5][1].replace("\t", "\n")), (2, docs[2][1]), (2, docs[9][1]), (None, docs[4][1]), (102, None), (103, ""), (104, "a " * 30_000), (105, "a " * 30_000), (106, passages[1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("starts", F.lit(1))
    for length in (50, 7):
        got = [tuple(r) for r in substrings.remove_repeats(frame, length).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
        assert sorted(got, key=str) == sorted(repeats(docs, length), key=str)
    assert substrings.remove_repeats(frame.limit(0)).count() == 0


def test_pipeline_keeps_the_first_of_each_group(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.choice((3, 60, 300)))) for _ in range(40)]
    texts += [t.upper() for t in texts[:10]] + [t + " end" for t in texts[:25]] + [None, "", " "]
    prints = [simhash.fingerprint_of(t) & (1 << 64) - 1 for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    least = smallest_reachable(range(len(texts)), links)
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("dropped", F.lit(1))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    want = [i for i, _ in rows if i is None or least.get(i, i) == i]
    assert len(want) < len(rows) - 10
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
