"""Toxicity of noisy text: decode obfuscated words by a noisy channel, then score the restored text.

Words that hold something else than letters, repeated letters, or that are spelled out with gaps become character lattices:
a look-alike sign may stand for a letter or for nothing, a run may stand for one or two letters, a gap between single letters
may be there or not, a star inside a word may stand for any letter, and among Latin letters a look-alike of another script
stands for its double. A Viterbi search finds the reading that is likeliest under a character trigram model of the
corpus, times the channel's costs. Words of plain letters have one reading, themselves; when texts are scored, words with
double letters and neighbouring pieces of words are decoded too, if a reading with evidence is possible at all.

The restored words are scored by word and word-beginning evidence. A feature counts if labelled texts tell, beyond
what chance yields among all features tried, that it goes with toxic texts; its weight is its log odds ratio. Near copies
count once here, as they share all their words.

The trigram model counts all texts. The evidence is fitted on at most :data:`FIT_ROWS` labelled rows, those with the
smallest hash of their id. Both are small whatever the input: the alphabet cubed, and the features of the sample.

Defined results: null and empty texts score as texts without evidence; repeated rows get equal scores; with no labels at
all, no text has evidence and none is rejected; labels that are null, or repeated with different values, count as given, a row
each; an empty table gives an empty result. Texts are read to their end. Other columns stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commsim.llm.columns import spare
from commsim.session import materialize

FIT_ROWS = 8_000
BEGINNINGS = (4, 5, 6)
HEAD = min(BEGINNINGS)
SMOOTH = 0.5
ALPHA = 0.05

# The alphabet of the character model: a word border, a to z, the Latin letters from 0xDF to 0xFF, and any other letter.
LETTERS = [chr(c) for c in range(97, 123)] + [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
OTHER = len(LETTERS) + 1
SIZE = OTHER + 1

LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
# Letters of the Cyrillic and Greek scripts that look like a Latin one; they count only among Latin letters.
SCRIPTS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x",
}
WILD = "*#"
WILD_RUN = 3  # longer runs are separators
# Natural logarithms of what the channel does to a text.
COST_LOOKALIKE, COST_NOISE, COST_LETTER_LOST, COST_JOIN, COST_WILD, COST_GAP = -2.0, -3.0, -1.0, -1.5, -3.3, -4.0
PIECES = 8

TOKEN = re.compile(r"\S+")
RUN = re.compile(r"(.)\1\1")
DOUBLE = re.compile(r"(.)\1+")
LATIN = re.compile("[a-z]")
FOREIGN = re.compile(f"[{''.join(SCRIPTS)}]")
# Single letters or look-alikes with any run of other signs between them; the two kinds of signs differ, so the search is linear.
SPELLED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+])(?:(?:[^\w@$!|+]|_)++(?:[^\W_]|[@$!|+])(?![^\W_])){2,}")
ODD = re.compile(r"[\d_@$!|+(<€£¡*#.\-​-‏⁠﻿]|(.)\1\1")


def code_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for letter, code in CODE.items():
        table[ord(letter)] = code
    return table


def count_trigrams(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Counts of the code trigrams of lower-case texts; any sign that is no letter is a border."""
    points = np.frombuffer("  ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(points < 256, table[np.minimum(points, 255)], OTHER)
    return np.bincount(c[:-2] * SIZE * SIZE + c[1:-1] * SIZE + c[2:], minlength=SIZE**3)


def _count_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, table, waiting, length = np.zeros(SIZE**3, np.int64), code_table(), [], 0
    for batch in batches:
        for text in batch["text"]:
            if text:
                waiting.append(text.lower())
                length += len(text)
                if length > 1_000_000:
                    total += count_trigrams(waiting, table)
                    waiting, length = [], 0
    if waiting:
        total += count_trigrams(waiting, table)
    seen = np.nonzero(total)[0]
    yield pd.DataFrame({"gram": seen, "n": total[seen]})


def trigram_model(docs: DataFrame) -> np.ndarray:
    """``log P(c | a, b)`` as an array ``[a, b, c]``, from all texts, with interpolated lower orders."""
    counts = docs.select("text").mapInPandas(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = np.zeros(SIZE**3)
    for row in counts.toLocalIterator():  # at most the alphabet cubed
        grams[row.gram] = row.n
    three = grams.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None, :, :]) / (three.sum(axis=2, keepdims=True) + 5)
    return np.log(p3)


def core_of(token: str) -> str:
    """A token without the signs at its edges, each of which is read once."""
    start, end = 0, len(token)
    while start < end and not token[start].isalnum():
        start += 1
    while end > start and not token[end - 1].isalnum():
        end -= 1
    return token[start:end]


def is_mixed(token: str) -> bool:
    """Whether letters of other scripts that look Latin stand among Latin ones."""
    return not token.isascii() and bool(FOREIGN.search(token)) and bool(LATIN.search(token))


def lattice(noisy: str) -> list[list[tuple[str, float]]]:
    """For every place the outputs, up to two letters each, with their cost."""
    places, i = [], 0
    if is_mixed(noisy):
        noisy = "".join(SCRIPTS.get(c, c) for c in noisy)
    while i < len(noisy):
        c, run = noisy[i], 1
        while i + run < len(noisy) and noisy[i + run] == c:
            run += 1
        if c.isalpha():
            places.append([(c, 0.0)] if run == 1 else [(c * 2, 0.0 if run == 2 else COST_LETTER_LOST), (c, COST_LETTER_LOST)])
        elif c in LOOKALIKES:
            readings = [(letter, COST_LOOKALIKE) for letter in LOOKALIKES[c]]
            if run > 1:
                readings += [(letter * 2, COST_LOOKALIKE) for letter in LOOKALIKES[c]]
            places.append([*readings, ("", COST_NOISE)])
        elif c in WILD and run <= WILD_RUN and i and noisy[i - 1].isalpha() and noisy[i + run : i + run + 1].isalpha():
            places += [[("", 0.0), (" ", COST_JOIN), *((letter, COST_WILD) for letter in LETTERS[:26])]] * run
        else:
            places.append([("", 0.0), (" ", COST_JOIN)])
        i += run
    return places


def viterbi(noisy: str, model: np.ndarray) -> str:
    """The likeliest reading of a lower-case noisy word or spelled-out word; may hold spaces."""
    paths: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}  # a text is a chain of outputs, so that long ones are not copied
    for outputs in lattice(noisy):
        onward: dict[tuple[int, int], tuple] = {}
        for (a, b), (score, chain) in paths.items():
            for out, cost in outputs:
                x, y, total = a, b, score + cost
                for letter in out:
                    code = 0 if letter == " " else CODE.get(letter, OTHER)
                    total += model[x, y, code]
                    x, y = y, code
                if (x, y) not in onward or total > onward[x, y][0]:
                    onward[x, y] = (total, (chain, out) if out else chain)
        paths = onward
    chain = max(((score + model[a, b, 0], chain) for (a, b), (score, chain) in paths.items()), key=lambda p: p[0])[1]
    letters = []
    while chain is not None:
        chain, out = chain
        letters.append(out)
    return "".join(reversed(letters))


def readings(token: str, model: np.ndarray) -> list[str]:
    """The restored words of one lower-case token."""
    core = core_of(token)
    mixed = is_mixed(token)
    if not mixed and core.isalpha() and not RUN.search(core) and not any(c in LOOKALIKES for c in token):
        return [core]
    if not mixed and not ODD.search(token) or not any(c.isalpha() for c in token):
        return re.findall(r"[^\W\d_]+", token)
    plain = re.findall(r"[^\W\d_]+", token)
    # Signs at the edges are read as letters too.
    decoded = viterbi(token, model).split()
    return [*decoded, *(w for w in plain if w not in decoded)]


def is_plain(token: str) -> bool:
    """Whether a token has itself as its one reading, doubled letters apart."""
    return token.isalpha() and not RUN.search(token) and not is_mixed(token)


def skeleton(word: str) -> str:
    """A word with every run of a letter as one letter, which its readings share."""
    return DOUBLE.sub(r"\1", word)


def restore(text: str, model: np.ndarray, known: dict[str, list[str]] | None = None) -> set[str]:
    """The distinct restored words of a text."""
    lower = text.lower()
    words: set[str] = set()
    for match in SPELLED.finditer(lower):
        words.update(viterbi(match.group(), model).split())
    for token in set(lower.split()):
        if is_plain(token):
            words.add(token)
            continue
        found = known.get(token) if known is not None else None
        if found is None:
            found = readings(token, model)
            if known is not None:
                if len(known) > 100_000:
                    known.clear()
                known[token] = found
        words.update(found)
    return words


def features(word: str) -> list[str]:
    """The word and its longer beginnings, which inflected words share."""
    return [word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]]


@dataclass
class Model:
    """Everything a worker needs to score texts."""

    characters: np.ndarray
    weights: dict[str, float]
    prior: float
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)
    heads: set[str] = field(default_factory=set)
    bones: set[str] = field(default_factory=set)
    starts: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        stems = [f.rstrip("*") for f in self.weights]
        self.heads = {stem[:HEAD] for stem in stems}
        self.bones = {skeleton(head) for head in self.heads}
        self.starts = {stem[:n] for stem in stems for n in range(1, len(stem) + 1)}

    def weight(self, word: str) -> float:
        if word[:HEAD] not in self.heads:
            return 0.0
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def doubled(self, token: str) -> tuple[str, ...]:
        """The reading of a plain word with double letters, if it is a word with evidence."""
        bone = skeleton(token)
        if not any(bone[:n] in self.bones for n in range(1, HEAD + 1)):
            return ()
        word = viterbi(token, self.characters)
        return (word,) if self.weight(word) > 0 else ()

    def pieced(self, tokens: list[str]) -> set[str]:
        """Words with evidence of their own, cut in pieces by white space, if the text is much likelier without the gaps."""
        found: set[str] = set()
        for at in [i for i, token in enumerate(tokens) if token in self.starts]:
            joined = tokens[at]
            for n, piece in enumerate(tokens[at + 1 : at + PIECES], 2):
                piece = core_of(piece)
                if not piece.isalpha():
                    break
                joined += piece
                if len(joined) >= HEAD and joined in self.weights and joined not in found:
                    parts = [core_of(part) for part in tokens[at : at + n]]
                    if self.likely(joined) + COST_GAP > sum(map(self.likely, parts)):
                        found.add(joined)
                if joined not in self.starts:
                    break
        return found

    def likely(self, word: str) -> float:
        """The log likelihood of a word and the border behind it."""
        codes = [0, 0, *(CODE.get(c, OTHER) for c in word), 0]
        return float(sum(self.characters[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:])))

    def score(self, text: str | None) -> float:
        """The probability of label 1: every distinct restored word adds its strongest evidence."""
        lower, total = (text or "").lower(), self.prior
        seen: set[str] = set()
        for match in SPELLED.finditer(lower):
            seen.update(w for w in viterbi(match.group(), self.characters).split() if self.weight(w) > 0)
        if len(self.known) > 200_000:
            self.known.clear()
        known = self.known
        tokens = lower.split()
        seen |= self.pieced(tokens)
        for token in set(tokens):
            hits = known.get(token)
            if hits is None:
                if is_plain(token):
                    if self.weight(token) > 0:
                        seen.add(token)
                        continue
                    if not DOUBLE.search(token):
                        continue
                    hits = self.doubled(token)
                else:
                    hits = tuple(w for w in readings(token, self.characters) if self.weight(w) > 0)
                known[token] = hits
            if hits:
                seen.update(hits)
        total += sum(self.weight(w) for w in seen)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, total))))


def _count_features(model: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                counts[int(toxic)].update({f for w in restore(text or "", model) for f in features(w)})
        names = list(set(counts[0]) | set(counts[1]))
        if names:
            yield pd.DataFrame({"feature": names, "clean": [counts[0][f] for f in names], "toxic": [counts[1][f] for f in names]})

    return run


def _candidates_of(model: np.ndarray, candidates: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {f: i for i, f in enumerate(candidates)}
        for batch in batches:
            held = [
                sorted({place[f] for w in restore(text or "", model) for f in features(w) if f in place}) for text in batch["text"]
            ]
            some = pd.DataFrame({"toxic": batch["toxic"].astype("int32"), "held": held})
            yield some[some["held"].map(len) > 0]

    return run


def evidence(toxic: int, clean: int, base: float) -> float:
    """Likelihood ratio statistic of a feature that goes with toxic texts, 0 for others."""
    if not toxic or toxic / (toxic + clean) <= base:
        return 0.0
    rate = toxic / (toxic + clean)
    return 2 * (toxic * math.log(rate / base) + (clean * math.log((1 - rate) / (1 - base)) if clean else 0.0))


def telling(candidates: list[str], rows: list[tuple[int, list[int]]], least: float, base: float) -> list[str]:
    """The candidates that tell toxic texts by themselves; a beginning has to without the longer words taken, or beyond the best of them."""
    holders: list[list[int]] = [[] for _ in candidates]
    for r, (_, held) in enumerate(rows):
        for f in held:
            holders[f].append(r)
    chosen: list[str] = []
    taken: dict[str, set[int]] = {}
    best: dict[str, float] = {}
    for f in sorted(range(len(candidates)), key=lambda f: (candidates[f].endswith("*"), -len(candidates[f]), candidates[f])):
        name = candidates[f].rstrip("*")
        left = [r for r in holders[f] if r not in taken.get(name, ())] if candidates[f].endswith("*") else holders[f]
        n, own = sum(rows[r][0] for r in left), sum(rows[r][0] for r in holders[f])
        gain = evidence(own, len(holders[f]) - own, base)
        if evidence(n, len(left) - n, base) >= least or gain - best.get(name, 0.0) >= least:
            chosen.append(candidates[f])
            for k in BEGINNINGS:
                if len(name) >= k:
                    taken.setdefault(name[:k], set()).update(holders[f])
                    best[name[:k]] = max(best.get(name[:k], 0.0), gain)
    return chosen


def copy_key(text: str | None) -> int:
    """The smallest hash of the text's three-word shingles, which most of a text's near copies share."""
    import xxhash

    words = (text or "").lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) >> 1 for i in range(max(1, len(words) - 2))), default=0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from the texts of ``docs`` and the labelled rows that are not held out."""
    characters = trigram_model(docs)
    chosen = (
        labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .select("doc_id", "toxic")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(materialize(chosen, "fit_ids")), "doc_id"), "fit")
    key = F.pandas_udf(lambda texts: texts.map(copy_key).astype("int64"), T.LongType())
    copies = sample.withColumn("copy", key(F.coalesce("text", F.lit("")))).groupBy("toxic", "copy").agg(F.min("doc_id").alias("doc_id"))
    sample = materialize(sample.join(copies.select("doc_id", "toxic"), ["doc_id", "toxic"]), "fit")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not toxic or not clean:
        return Model(characters, {}, -10.0 if not toxic else 10.0)
    dealt = sample.repartition(F.xxhash64("doc_id"))
    counts = dealt.mapInPandas(_count_features(characters), "feature string, clean long, toxic long")
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts, "features")
    # The likelihood ratio must be beyond what chance gives among all features with this many rows.
    tried = max(2, counts.where("clean + toxic > 1").count())
    base = toxic / (toxic + clean)
    rate = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = 2 * (
        F.when(F.col("toxic") > 0, F.col("toxic") * F.log(rate / base)).otherwise(0.0)
        + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    )
    chosen_features = counts.where((rate > base) & (gain >= 2 * math.log(tried / ALPHA))).select("feature", "clean", "toxic")
    candidates = {r.feature: (r.clean, r.toxic) for r in chosen_features.toLocalIterator()}  # bounded by the sample
    held = dealt.mapInPandas(_candidates_of(characters, list(candidates)), "toxic int, held array<int>").toLocalIterator()
    listed = telling(list(candidates), [(r.toxic, r.held) for r in held], 2 * math.log(tried / ALPHA), base)
    weights = {}
    for f in listed:
        c, t = candidates[f]
        weights[f] = math.log((t + SMOOTH) / (toxic + 2 * SMOOTH)) - math.log((c + SMOOTH) / (clean + 2 * SMOOTH))
    return Model(characters, weights, math.log(toxic / clean))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``, the probability that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.characters, model.weights, model.prior))
    held: list[Model] = []  # one per worker, with the tokens it has met

    @F.pandas_udf(T.DoubleType())
    def scores(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Model(*shared.value))
        return texts.map(held[0].score).astype("float64")

    return docs.withColumn(out, scores(F.coalesce(F.col("text"), F.lit(""))))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, with the columns of ``docs``."""
    out = spare(docs, "__toxicity")
    scored = score(docs, fit(docs, labels), out)
    return scored.where(F.col(out) < threshold).select(*docs.columns)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
