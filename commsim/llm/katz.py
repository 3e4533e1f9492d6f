"""Language-model scores by Katz backoff with Good-Turing discounts and exactly normalised backoff weights.

Events are the words of the training texts, the end of a text, and one event for any unknown word. The orders are bigrams
of all events, contexts being words and the start of a text, and unigrams. Each order discounts its counts up to 5 by
Good-Turing. What the unigrams set free is the probability of an unknown word; what the bigrams of a context set free goes to the
events unseen after it, in proportion to their unigrams, by a weight that makes the context's distribution sum to 1.

How it runs:

1. Texts are read once, in batches of about :data:`BATCH_TOKENS` tokens, each written as a row: its words, how often training texts
   hold each, and the texts as numbers of these words.
2. Words are counted by a shuffle and numbered by falling count. A word's count, and so its unigram, follows from its number by the
   table of different counts, which has at most ``sqrt(2 N)`` rows for ``N`` tokens; that is what goes to every task. A join brings each
   batch the numbers of its own words.
3. Each batch sends its different bigrams with their training counts to slots, as sorted numbers kept as differences. A slot adds
   up the counts, writes its part of the bigram table and answers each batch in the order it asked: the count of a bigram, or, for a
   bigram never seen, what the weight of its context follows from. All bigrams of a context meet in one slot. Only those of head words,
   which make up at least :data:`HEAD_SHARE` of the tokens, and of the start of a text are spread over all slots; of these there
   are at most 10,001, whose sums are added up and go to every task.
4. Each batch scores its texts from the answers: a seen bigram by its discounted count, any other by the weight of its context and
   the unigram of its word.

Defined results: null and empty texts are one end token; repeated rows get equal results; a null id is a training row; with no
training text every word is unknown, with probability 1; after an unknown word a word has its unigram; an empty table gives an
empty result. Whole texts count and are scored. ``score`` is the log10 probability of a text's words and its end. Bigrams are numbers
below ``2 ** 63``, so there may be three thousand million different words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commsim.operators.index import number_rows
from commsim.session import materialize

HEAD_SHARE = 1e-4
FREQUENT_SHARE = 1e-5
BATCH_TOKENS = 1 << 21
SLOT_TOKENS = 1 << 20
DISCOUNTED = 5
END = "\n"  # no word holds white space

TEXTS = "batch long, ids array<long>, absent array<boolean>, held array<boolean>, lengths array<int>, tokens binary, words array<string>, times array<long>"
REQUESTS = "batch long, slot long, pairs binary, times binary"
ANSWERS = "batch long, slot long, pairs binary, times binary, shapes binary, lower binary, "
ANSWERS += "sizes array<long>, heads array<long>, head_shapes array<long>, head_lower array<double>"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens_of(text: str | None) -> list[str]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return [w.decode("utf-8", "surrogatepass") for w in words]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """``d[r]`` for counts 0 to 5; where the counts of counts allow no Good-Turing estimate, ``(r - 1/2) / r``."""
    n = [counts_of_counts.get(r, 0) for r in range(DISCOUNTED + 2)]
    d = np.ones(DISCOUNTED + 1)
    tail = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        turing = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        value = (turing - tail) / (1 - tail) if tail < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED).astype(np.int64)], 1.0)


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on as planes of bytes, lowest first, behind the number of planes; Spark's codecs compress them well."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    cells = np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8)
    return bytes([width]) + cells[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    cells = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    cells[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1).T
    return cells.view("<i8").ravel()


def packed_rising(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=0))


def unpacked_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first = TaskContext.get().partitionId() << 32
    number, size = 0, 0
    place: dict[str, int] = defaultdict()
    place.default_factory = place.__len__
    ids, held, texts = [], [], []

    def row() -> pd.DataFrame:
        lengths = np.array([len(t) for t in texts])
        flat = np.concatenate(texts)
        times = np.bincount(flat[np.repeat(~np.array(held, bool), lengths)], minlength=len(place))
        absent = [i is None for i in ids]
        values = (first + number, [i or 0 for i in ids], absent, held, lengths.tolist(), packed(flat), list(place), times)
        return pd.DataFrame([values], columns=["batch", "ids", "absent", "held", "lengths", "tokens", "words", "times"])

    for batch in batches:
        for doc_id, text, out in zip(batch["doc_id"].astype(object), batch["text"], batch["held_out"]):
            words = [*tokens_of(text), END]
            texts.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
            ids.append(None if pd.isna(doc_id) else int(doc_id))
            held.append(bool(out))
            size += len(words)
            if size >= BATCH_TOKENS:
                yield row()
                number, size = number + 1, 0
                place.clear()
                ids, held, texts = [], [], []
    if texts:
        yield row()


class Unigrams:
    """What follows from a word's number: numbers rise as counts fall, ``types`` is an unknown word, ``types + 1`` a text's start."""

    def __init__(self, of_counts: list[tuple[int, int]], texts: int):
        of_counts = sorted(of_counts, reverse=True)
        counts = np.array([n for n, _ in of_counts], np.int64)
        sizes = np.array([k for _, k in of_counts], np.int64)
        self.total, self.types = int((counts * sizes).sum()), int(sizes.sum())
        self.d = discounts(dict(of_counts))
        # The mass that discounts set free; with nothing to discount, one token's worth.
        freed = float(sum(r * (1 - self.d[r]) * k for r, k in of_counts if r <= DISCOUNTED))
        self.scale, freed = (self.total, freed) if freed > 0 else (self.total + 1, 1.0)
        self.head = int(sizes[counts >= HEAD_SHARE * self.total].sum())
        self.slots = max(1, -(-self.total // SLOT_TOKENS))
        self.last = np.cumsum(np.concatenate((sizes, [1, 1])))
        self.counts = np.concatenate((counts, [0, texts]))
        p = np.concatenate((discounted(counts, self.d) / self.scale, [freed / self.scale, 1.0]))
        self.logs = np.log10(np.maximum(p, 1e-300))

    def level(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.last, ids, side="right")

    def is_head(self, contexts: np.ndarray) -> np.ndarray:
        return (contexts < self.head) | (contexts == self.types + 1)

    def slot(self, pairs: np.ndarray) -> np.ndarray:
        contexts = pairs // (self.types + 2)
        mixed = np.where(self.is_head(contexts), pairs, contexts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(33)) % np.uint64(self.slots)).astype(np.int64)

    def events(self, row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of a batch's words as they stand, those of their contexts, and where texts start."""
        number = np.full(len(row.times), self.types, np.int64)
        if row.places is not None:
            number[np.asarray(row.places, np.int64)] = np.asarray(row.numbers, np.int64)
        ids = number[unpacked(row.tokens)]
        starts = np.concatenate(([0], np.cumsum(np.asarray(row.lengths, np.int64))[:-1]))
        before = np.concatenate(([0], ids[:-1]))
        before[starts] = self.types + 1
        return ids, before, starts


def _ask(shared):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        words, out = Unigrams(*shared.value), []
        for row in frame.itertuples():
            ids, before, _ = words.events(row)
            known = before != words.types
            train = np.repeat(~np.asarray(row.held, bool), row.lengths)[known]
            pairs, at = np.unique((before * (words.types + 2) + ids)[known], return_inverse=True)
            times = np.bincount(at[train], minlength=len(pairs))
            slots = words.slot(pairs)
            order = np.argsort(slots, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(slots[order])) + 1):
                if len(part):
                    out.append((row.batch, int(slots[part[0]]), packed_rising(pairs[part]), packed(times[part])))
        return pd.DataFrame(out, columns=["batch", "slot", "pairs", "times"])

    return run


def _answer(shared):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        words = Unigrams(*shared.value)
        asked = [unpacked_rising(p) for p in frame["pairs"]]
        pairs, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, at, np.concatenate([unpacked(t) for t in frame["times"]]))
        seen = counts > 0
        contexts, of = np.unique(pairs // (words.types + 2), return_inverse=True)
        p = 10.0 ** words.logs[words.level(pairs[seen] % (words.types + 2))]
        lower = np.bincount(of[seen], weights=p, minlength=len(contexts))
        shapes = np.stack([np.bincount(of[counts == r], minlength=len(contexts)) for r in range(1, DISCOUNTED + 1)], 1)
        head = words.is_head(contexts)
        # A count and whether the context has no discounted bigram at all.
        codes = counts * 2 + ~shapes.any(axis=1)[of]
        out, begin = [], 0
        for batch, mine in zip(frame["batch"], asked):
            here = at[begin : begin + len(mine)]
            begin += len(mine)
            missed = np.unique(of[here[~seen[here]]])
            missed = missed[~head[missed]]
            out.append((batch, None, packed(codes[here]), packed(shapes[missed].ravel()), lower[missed].tobytes(), None, None, None, None))
        sizes = [int((counts == r).sum()) for r in range(1, DISCOUNTED + 2)]
        met = head & (np.bincount(of[seen], minlength=len(contexts)) > 0)
        table = (packed_rising(pairs[seen]), packed(counts[seen]), None, None, sizes)
        out.append((None, *table, contexts[met].tolist(), shapes[met].ravel().tolist(), lower[met].tolist()))
        columns = ["batch", "pairs", "times", "shapes", "lower", "sizes", "heads", "head_shapes", "head_lower"]
        answers = pd.DataFrame(out, columns=columns).astype({"batch": "Int64"})
        return answers.assign(slot=int(frame["slot"].iloc[0]))

    return run


def backoff_weights(totals: np.ndarray, shapes: np.ndarray, lower: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log10 weights of contexts from their counts, their numbers of bigrams seen 1 to 5 times and the unigrams of all they saw."""
    freed = shapes @ (np.arange(1, DISCOUNTED + 1) * (1 - d[1:]))
    # A context whose bigrams leave nothing gives one event's worth to the others.
    return np.log10(np.where(freed > 0, freed / np.maximum(totals, 1), 1 / (totals + 1))) - np.log10(1 - lower)


def _score(shared, heads):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        words, (d, weights, flat) = Unigrams(*shared.value), heads.value
        start, width = words.types + 1, words.types + 2
        done = []
        for row in frame.itertuples():
            ids, before, starts = words.events(row)
            known = before != words.types
            levels = words.level(ids)
            scores, counts = words.logs[levels], words.counts[levels]
            pairs, at = np.unique((before * width + ids)[known], return_inverse=True)
            slots = words.slot(pairs)
            order = np.argsort(slots, kind="stable")
            replies = np.argsort(np.asarray(row.slots, np.int64)) if row.slots is not None else []
            codes = np.empty(len(pairs), np.int64)
            codes[order] = np.concatenate([unpacked(row.codes[i]) for i in replies]) if len(pairs) else []
            context = pairs // width
            totals = words.counts[words.level(context)]
            head = words.is_head(context)
            place = np.where(context == start, words.head, np.where(head, context, 0))
            n, empty = codes >> 1, np.where(head, flat[place], codes & 1 == 1)
            logs = words.logs[words.level(pairs % width)] + np.where(head, weights[place], 0.0)
            # Contexts of unseen bigrams outside the head, slot by slot in rising order, as they were answered.
            part = order[((n == 0) & ~head)[order]]
            if len(part):
                first = np.concatenate(([True], (np.diff(context[part]) != 0) | (np.diff(slots[part]) != 0)))
                shapes = np.concatenate([unpacked(row.shapes[i]) for i in replies]).reshape(-1, DISCOUNTED)
                lower = np.concatenate([np.frombuffer(row.lower[i]) for i in replies])
                logs[part] += backoff_weights(totals[part][first], shapes, lower, d)[np.cumsum(first) - 1]
            seen = n > 0
            logs[seen] = np.log10(discounted(n[seen], d) / (totals[seen] + empty[seen]))
            scores[known] = logs[at]
            base = np.log10(counts + 0.5) - np.log10(words.total + 0.5 * (words.types + 1))
            done.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.arrays.IntegerArray(np.array(row.ids, np.int64), np.array(row.absent, bool)),
                        "held_out": np.asarray(row.held, bool),
                        "n_tokens": np.asarray(row.lengths, np.int64),
                        "n_known": np.add.reduceat((counts > 0).astype(np.int64), starts),
                        "train_tokens": words.total,
                        "base_score": np.add.reduceat(base, starts),
                        "score": np.add.reduceat(scores, starts),
                    }
                )
            )
        return pd.concat(done)

    return run


def read_texts(docs: DataFrame) -> DataFrame:
    """Batches of the texts of ``(doc_id, text)``, written: their words, training counts and the texts as places of these words."""
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return materialize(rows.mapInPandas(_read, TEXTS), "texts")


def count_words(texts: DataFrame) -> tuple[DataFrame, tuple]:
    """``(word, n, id)`` of the training words with ids by falling count, and what :class:`Unigrams` is made of."""
    entries = texts.select(F.explode(F.arrays_zip("words", "times")).alias("w")).select("w.words", "w.times")
    counted = entries.where("times > 0").groupBy("words").agg(F.sum("times").alias("n"))
    counted = materialize(counted.select(F.struct((-F.col("n")).alias("less"), F.col("words").alias("word")).alias("by")), "words")
    of_counts = [(-r.less, r.k) for r in counted.groupBy("by.less").agg(F.count("*").alias("k")).collect()]  # at most sqrt(2 N)
    ends = sum(-r.less for r in counted.where(F.col("by.word") == END).select("by.less").collect())
    ids = number_rows(counted, "by", "id").frame.select("by.word", (-F.col("by.less")).alias("n"), "id")
    return ids, (of_counts, ends)


def place_words(texts: DataFrame, ids: DataFrame, total: int) -> DataFrame:
    """``(batch, places, numbers)``: the ids of each batch's words that training texts hold, written."""
    entries = texts.select("batch", F.posexplode("words").alias("at", "word"))
    often = F.broadcast(ids.where(F.col("n") >= FREQUENT_SHARE * total).select("word", "id"))  # at most 1 / FREQUENT_SHARE rows
    rare = entries.join(often, "word", "left_anti").join(ids.where(F.col("n") < FREQUENT_SHARE * total), "word")
    found = entries.join(often, "word").select("batch", "at", "id").union(rare.select("batch", "at", "id"))
    placed = found.groupBy("batch").agg(F.collect_list(F.struct("at", "id")).alias("p"))  # no more than the batch has words
    return materialize(placed.select("batch", F.col("p.at").alias("places"), F.col("p.id").alias("numbers")), "placed")


def count_pairs(encoded: DataFrame, shared) -> DataFrame:
    """The bigram table, a row for each slot with a null batch, and the answers to each batch; written."""
    asked = encoded.groupBy("batch").applyInPandas(_ask(shared), REQUESTS)
    return materialize(asked.groupBy("slot").applyInPandas(_answer(shared), ANSWERS), "bigrams")


def head_contexts(answers: DataFrame, words: Unigrams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bigrams' discounts, and for head words and the start of a text their weights and whether nothing is discounted."""
    table = answers.where("batch IS NULL")
    sizes = table.agg(*[F.sum(F.col("sizes")[r]).alias(f"n{r}") for r in range(DISCOUNTED + 1)]).first()
    d = discounts({r + 1: n or 0 for r, n in enumerate(sizes)})
    met = table.select(F.posexplode("heads").alias("at", "head"), "head_shapes", "head_lower")
    shape = [F.sum(F.col("head_shapes")[F.col("at") * DISCOUNTED + r]).alias(f"n{r}") for r in range(DISCOUNTED)]
    sums = met.groupBy("head").agg(F.sum(F.col("head_lower")[F.col("at")]).alias("lower"), *shape).collect()  # at most 1 / HEAD_SHARE + 1
    weights, flat = np.zeros(words.head + 1), np.zeros(words.head + 1, bool)
    if sums:
        context = np.array([r["head"] for r in sums])
        place = np.minimum(context, words.head)
        shapes = np.array([[r[f"n{i}"] for i in range(DISCOUNTED)] for r in sums])
        weights[place] = backoff_weights(words.counts[words.level(context)], shapes, np.array([r.lower for r in sums]), d)
        flat[place] = ~shapes.any(axis=1)
    return d, weights, flat


def scored(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row of ``(doc_id, text)``."""
    context = docs.sparkSession.sparkContext
    texts = read_texts(docs)
    ids, made_of = count_words(texts)
    words = Unigrams(*made_of)
    shared = context.broadcast(made_of)
    encoded = texts.drop("words").join(place_words(texts, ids, words.total), "batch", "left")
    answers = count_pairs(encoded, shared)
    heads = context.broadcast(head_contexts(answers, words))
    reply = F.collect_list(F.struct("slot", "times", "shapes", "lower")).alias("r")  # no more than the batch has bigrams
    replies = answers.where("batch IS NOT NULL").groupBy("batch").agg(reply)
    replies = replies.select("batch", F.col("r.slot").alias("slots"), F.col("r.times").alias("codes"), "r.shapes", "r.lower")
    return encoded.join(replies, "batch", "left").groupBy("batch").applyInPandas(_score(shared, heads), SCORES)


def op7_katz(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
