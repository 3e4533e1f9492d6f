"""Obfuscations at the edges of words, spelled-out words and long strings."""

from __future__ import annotations

import numpy as np
import pytest

from commsim.llm import toxicity


@pytest.fixture(scope="module")
def model():
    grams = toxicity.count_trigrams(["the idiot scum asshole garden and water moron"] * 50, toxicity.code_table())
    three = grams.reshape((toxicity.SIZE,) * 3) + 0.01
    return toxicity.Model(np.log(three / three.sum(axis=2, keepdims=True)), {w: 9.0 for w in ("idiot", "scum", "asshole")}, -3.0)


def test_signs_at_the_edges_are_read_as_letters(model):
    for noisy in ("@sshole", "$cum", "!diot", "idio+", "idiot!", "(idiot)"):
        assert model.score(f"the garden {noisy} and water") > 0.5, noisy


def test_spelled_out_words_end_at_any_sign(model):
    for noisy in ("i d i o t!", "i d i o t.", "i d i o t,", "(i d i o t)", "i - d - i - o - t", "i/d/i/o/t", "i\nd\ni\no\nt", "i_d_i_o_t"):
        assert model.score(f"the garden {noisy} and water") > 0.5, noisy
    assert model.score("a garden, a b c and the water") < 0.5


def test_long_strings_are_not_cut(model):
    for n in range(8):
        assert model.score("the/" * n + "garden/" * (8 - n // 2) + "1d1ot") > 0.5, n
    assert model.score("1 " * 50_000) < 0.5 and model.score("!" * 100_000 + "a" + "$ " * 50_000) < 0.5


def test_doubled_letters(model):
    for noisy in ("iddiot", "iidiioott", "scuum", "asshhole", "idiott"):
        assert model.score(f"the garden {noisy} and water") > 0.5, noisy
    assert model.score("the gardden and watter moorron") < 0.5


def test_words_in_pieces(model):
    for noisy in ("id iot", "ass hole", "i d iot", "idi ot!", "asshol e", "s cum"):
        assert model.score(f"the garden {noisy} and water") > 0.5, noisy
    for clean in ("id water iot", "ass. the hole", "the i d and water", "sc the um"):
        assert model.score(clean) < 0.5, clean
    assert model.score("i " * 100_000) < 0.5


def test_wildcards(model):
    for noisy in ("id*ot", "i**ot", "sc#m", "a**hole"):
        assert model.score(f"the garden {noisy} and water") > 0.5, noisy
    assert model.score("gar*en *water* " + "*" * 50_000 + "a" + "*" * 50_000 + "b") < 0.5


def test_letters_of_other_scripts(model):
    for noisy in ("idi\u043et", "\u0456diot", "\u0455\u0441um", "\u0430sshole"):
        assert model.score(f"the garden {noisy} and water") > 0.5, noisy
    assert model.score("\u0441\u043e\u0440 \u043d\u0435\u0442") < 0.5
    assert model.score("abcd\u00e9" * 100_000) < 0.5
