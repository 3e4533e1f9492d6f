"""Packing: every token of every document once, gapless sequences within capacity, and few of them."""

from __future__ import annotations

import bisect
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from commsim.llm import packing


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    free, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(free, x)
        room = free.pop(k) if k < len(free) else capacity
        n += room == capacity
        if room > x:
            bisect.insort(free, room - x)
    return n


def check_layout(rows, capacity: int) -> int:
    """Sequences are gapless from 0 and within capacity; gives their number."""
    filled: dict[int, list] = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    return len(filled)


DISTRIBUTIONS = {
    "mixed": lambda rng: min(2048, int(rng.lognormvariate(5.5, 1.3)) + 1),
    "short": lambda rng: rng.randint(1, 6),
    "equal": lambda rng: 5,
    "halves": lambda rng: rng.choice((1024, 1023, 1025, 2048, 1)),
    "long": lambda rng: rng.randint(1200, 2048),
}


@pytest.mark.parametrize("kind", list(DISTRIBUTIONS))
def test_few_gapless_sequences(spark, kind):
    rng = random.Random(4)
    lengths = [DISTRIBUTIONS[kind](rng) for _ in range(1500)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(3)
    rows = packing.pack(pieces).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == sorted(enumerate(lengths))
    used, best = check_layout(rows, 2048), best_fit_decreasing(lengths, 2048)
    assert used <= best * 1.02 + 2


def test_leftovers_of_ranges_meet_by_rank():
    borrowed, opened, rank = packing.match_leftovers([(0, 1, 2), (1, 3, 1), (3, 1, 0), (2, 0, 2)])
    assert opened == [(0, 0, 0), (1, 2, 1)] and rank == 2
    assert borrowed == [(1, 0, 2, 0, 2), (3, 0, 1, 2, 2)]


def test_classes_cover_all_lengths_once():
    for capacity in (2, 3, 16, 2048):
        ranges = packing.classes(capacity)
        assert [n for above, up_to in ranges for n in range(up_to, above, -1)] == list(range(capacity - 1, 0, -1))


TEXTS = [
    (1, "It's a  plain Text, isn't it?\n\tYes."),
    (2, None),
    (3, ""),
    (None, "no id"),
    (4, " Straße　ΣΑΣ é <|endoftext|>x 12345 \U0001f600\U0001f600 don't"),
    (5, "many words of one long text " * 900),
    (1, "It's a  plain Text, isn't it?\n\tYes."),
]


@pytest.mark.parametrize("by_words, cache", [(True, 300_000), (True, 3), (False, 1)])
def test_pieces_hold_all_ids(spark, by_words, cache):
    path = packing.public_vocabulary()
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = packing.token_pieces(docs, path, capacity=64, by_words=by_words, word_cache=cache).collect()
    tokenizer = Tokenizer.from_file(path)
    expected = []
    for doc_id, text in TEXTS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        expected += [(doc_id, k, at, ids[at : at + 64]) for k, at in enumerate(range(0, len(ids), 64))]
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist())) for r in rows)
    assert all(r.length * 4 == len(r.ids) for r in rows)


def test_words_encode_as_in_their_text():
    path = packing.public_vocabulary()
    with open(path, encoding="utf-8") as file:
        content = file.read()
    tokenizer, (_, ids_of) = Tokenizer.from_file(path), packing._word_encoder(content, 40)
    rng = random.Random(9)
    signs = "abcdeABCDEsStTß ÀéñÑµªÿŸĀıİσΣé́.,;:!?'’-_<|>09½²×÷ \t\n\u00a0\u2003\u0085"
    parts = ["'s", "'ll", "can't", "<|endoftext|>", "<|ENDOFTEXT|>", "...", "?!", "École", "über-", "don't,", "it's."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) if rng.random() < 0.2 else rng.choice(signs) for _ in range(rng.randint(0, 30)))
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids_of(text.encode().split()), "<u4").tolist() == expected, text


def test_sequences_hold_their_pieces(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    packed = packing.pack(packing.token_pieces(docs, packing.public_vocabulary(), capacity=64), capacity=64)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    with pytest.raises(ValueError):
        packing.pack(packed)


def test_query(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("length", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op13_packing(spark, str(tmp_path)).collect()
    check_layout(rows, 2048)
    tokenizer = Tokenizer.from_file(packing.public_vocabulary())
    for doc_id, text in TEXTS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc_id)
        cut = [(k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        assert mine == sorted(cut * [d for d, _ in TEXTS].count(doc_id))
