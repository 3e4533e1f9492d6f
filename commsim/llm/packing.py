"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Documents become token ids and a closing id; those longer than a sequence are cut. Full pieces are sequences of their own.
The others are placed by classes of length, the longest class first. A round places all pieces of a class:

1. Pieces and gaps (the room left in open sequences, as one or more slots that any piece of the class fits) are sorted together
   from large to small, by ranges over all tasks.
2. Each task sweeps its range: a piece takes the last slot passed, which is the least that holds it.
3. Pieces that meet no slot in their range take the last slots left over in the ranges before, by their rank among the
   leftovers; from each range two counts go to the driver, which matches the leftovers' ranks. Pieces without any slot open new
   sequences by rank, as many to each as surely fit.
4. The gaps are updated and the next class follows.

A class is narrow (a factor of at most 1.5 for long pieces), so a round wastes little, and shorter pieces fill what is left. The
number of rounds is that of the classes, whatever the input. No row holds more than one sequence, and every round is written to shared storage.

Ids of a word do not depend on other words when the tokenizer splits at white space, so each task encodes a word once and
remembers it; ``word_cache`` bounds the memory, not the result. Turn ``by_words`` off for tokenizers that read across white space.
Words of Latin letters go straight to the tokenizer's model, if its file says that it lower-cases and splits letters from all else.

Defined results: null and empty texts are the closing id alone; null ids are carried along; repeated rows are packed like any
others; an empty table gives an empty result. Whole texts are read. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commsim.session import materialize

CAPACITY = 2048
END = 0
WORD_CACHE = 500_000
LETTER_RUNS = r"[\p{L}]+"
CLOSING = ".,;:!?"  # signs that no pattern joins to letters before them
LAST_LETTER = "\u00ff"  # up to here, letters are composed and have one lower case
FRACTIONS = (2, 3, 4, 6, 8, 12, 16)  # of a sequence: bounds between classes
ROWS_PER_FILE = 500_000
WIDE = 4  # the step between bounds of shorter pieces

PIECES = "doc_id long, piece int, start long, length long, ids binary"
SWEPT = "part int, kind int, id long, length int, mate long, place long"
PIECE, SLOT, COUNTS = 0, 1, 2  # the kinds of rows that a sweep gives


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a vocabulary file of an installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> list[str]:
    """The sign by which byte-level tokenizers write each byte: itself if it is printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    signs, following = [], 256
    for byte in range(256):
        signs.append(chr(byte if byte in printable else following))
        following += byte not in printable
    return signs


def reads_letters_alone(config: dict) -> bool:
    """Whether a tokenizer lower-cases, splits runs of letters from all else, and then merges their bytes."""
    steps = {n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])}
    split, *rest = (config.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return (
        steps == {"NFC", "Replace", "Lowercase"}
        and LETTER_RUNS in split.get("pattern", {}).get("Regex", "").split("|")
        and [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
        and config.get("post_processor") is None
        and config["model"]["type"] == "BPE"
    )


def _word_encoder(vocabulary: str, word_cache: int):
    """Gives the ids of a word, as bytes; remembers words, and their letters without case and closing signs."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    by_letters, signs, merge = reads_letters_alone(json.loads(vocabulary)), _byte_signs(), tokenizer.model.tokenize
    parts: dict[str, bytes] = {}

    def whole(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(text: str) -> bytes:
        written = text if text.isascii() else "".join([signs[b] for b in text.encode()])
        return array("I", [t.id for t in merge(written)]).tobytes()

    def remembered(text: str, encode) -> bytes:
        ids = parts.get(text)
        if ids is None:
            if len(parts) >= word_cache:
                parts.clear()
            ids = parts[text] = encode(text)
        return ids

    class Words(dict):
        def __missing__(self, word: bytes) -> bytes:
            text = word.decode("utf-8", "replace")
            core = text.rstrip(CLOSING) if by_letters else ""
            if core.isalpha() and (core.isascii() or max(core) <= LAST_LETTER):
                ids = remembered(core.lower(), letters)
                if len(core) < len(text):
                    ids += remembered(text[len(core) :], whole)
            else:
                ids = whole(text)
            self[word] = ids
            return ids

    known = Words()

    def ids_of(words: list[bytes]) -> bytes:
        if len(known) > word_cache:
            known.clear()
        return b"".join(map(known.__getitem__, words))

    return whole, ids_of


def _encode(vocabulary: str, capacity: int, end: int, by_words: bool, word_cache: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, ids_of = _word_encoder(vocabulary, word_cache)
        closing = array("I", [end]).tobytes()
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                ids = (ids_of(text.encode("utf-8", "surrogatepass").split()) if by_words else whole(text)) + closing
                size += len(ids)
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    rows.append((doc_id, k, at, min(capacity, n - at), ids[4 * at : 4 * (at + capacity)]))
                if size > 1 << 24:
                    yield _frame(rows)
                    rows, size = [], 0
            if rows:
                yield _frame(rows)

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"]).astype({"doc_id": "Int64"})

    return run


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, by_words: bool = True, word_cache: int = WORD_CACHE
) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: the token ids of each ``text``, closed by ``end``, in pieces of at most ``capacity``.

    ``vocabulary`` is the path of a tokenizer file that the driver can read; its content travels to the tasks. ``ids`` are
    little-endian unsigned 32-bit numbers, on machines of that order.
    """
    with open(vocabulary, encoding="utf-8") as file:
        content = file.read()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(_encode(content, capacity, end, by_words, word_cache), PIECES)


def classes(capacity: int) -> list[tuple[int, int]]:
    """Ranges ``(above, up_to)`` of the lengths under ``capacity``, the longest first.

    Bounds stand at whole fractions of a sequence, so that a sequence opened for a class is filled up by its pieces.
    """
    bounds = {capacity - 1, 0, int(capacity * 0.5**0.5), *(capacity // k for k in FRACTIONS)}
    low = capacity // FRACTIONS[-1]
    while low > 1:
        low //= WIDE
        bounds.add(low)
    descending = sorted((b for b in bounds if 0 <= b < capacity), reverse=True)
    return list(zip(descending[1:], descending[:-1]))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matches the sorted rows of one range, numbers what finds no partner, and ends with the numbers of such pieces and slots."""
    slots: list[int] = []
    part, alone = -1, 0
    for batch in batches:
        if not len(batch):
            continue
        part = int(batch["part"].iloc[0])
        pieces, lengths, mates, places = [], [], [], []
        for is_slot, row_id, length in zip(batch["is_slot"].tolist(), batch["id"].tolist(), batch["length"].tolist()):
            if is_slot:
                slots.append(row_id)
                continue
            pieces.append(row_id)
            lengths.append(length)
            if slots:
                mates.append(slots.pop())
                places.append(-1)
            else:
                mates.append(None)
                places.append(alone)
                alone += 1
        yield _swept(part, PIECE, pieces, lengths, mates, places)
    for at in range(0, len(slots), 1 << 16):
        left = slots[at : at + (1 << 16)]
        yield _swept(part, SLOT, left, [0] * len(left), [None] * len(left), list(range(at, at + len(left))))
    if alone or slots:
        yield _swept(part, COUNTS, [alone], [0], [len(slots)], [-1])


def _swept(part: int, kind: int, ids: list, lengths: list, mates: list, places: list) -> pd.DataFrame:
    return pd.DataFrame({"part": part, "kind": kind, "id": ids, "length": lengths, "mate": pd.array(mates, "Int64"), "place": places})


def match_leftovers(counts: list[tuple[int, int, int]]) -> tuple[list[tuple], list[tuple], int]:
    """Matches leftovers of ranges ``(part, pieces, slots)`` by rank: ``(borrowed, opened, number without a slot)``.

    ``borrowed`` has ``(part, first, last, from_part, slots)``: the pieces of places ``first`` to ``last - 1`` take the slots of
    ``from_part`` from place ``slots - 1`` downwards. ``opened`` has ``(part, first, rank)``: pieces from place ``first`` on have no
    slot, and that rank among all of these. Both are at most twice as long as the list of ranges.
    """
    borrowed, opened, stack, rank = [], [], [], 0
    for part, pieces, slots in sorted(counts):
        at = 0
        while at < pieces and stack:
            lender, left = stack.pop()
            taken = min(pieces - at, left)
            borrowed.append((part, at, at + taken, lender, left))
            at += taken
            if taken < left:
                stack.append((lender, left - taken))
        if at < pieces:
            opened.append((part, at, rank))
            rank += pieces - at
        if slots:
            stack.append((part, slots))
    return borrowed, opened, rank


def _written(df: DataFrame, label: str, rows: int) -> DataFrame:
    """``df`` of about so many rows, written in files that grow with them rather than one for each shuffle partition."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, rows // ROWS_PER_FILE)
    return materialize(df.coalesce(tasks), label)


def place_class(pieces: DataFrame, count: int, gaps: DataFrame, above: int, up_to: int, capacity: int, next_gap: int) -> tuple[DataFrame, int]:
    """One round: ``(id, length, gap, opens)`` of all ``count`` ``pieces`` ``(id, length)`` of a class, and the next free number of a gap.

    The first piece of a new sequence ``opens`` it.
    """
    spark = pieces.sparkSession
    fits = F.greatest(F.lit(1), F.floor(F.col("free") / up_to)).cast("int")
    wide = gaps.where(F.col("free") > above).select("gap", "free", fits.alias("n"))
    slots = wide.select(F.lit(True).alias("is_slot"), F.col("gap").alias("id"), F.floor(F.col("free") / F.col("n")).cast("int").alias("length"), F.explode(F.sequence(F.lit(1), "n")).alias("number"))
    rows = slots.unionByName(pieces.select(F.lit(False).alias("is_slot"), "id", F.col("length").cast("int").alias("length"), F.lit(0).alias("number")))
    order = [F.col("length").desc(), F.col("is_slot").desc(), F.col("id"), F.col("number")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "is_slot", "id", "length")
    swept = _written(ranged.mapInPandas(_sweep, SWEPT), "swept", count + next_gap)
    counts = swept.where(F.col("kind") == COUNTS).select("part", "id", "mate").collect()
    borrowed, opened, rank = match_leftovers([tuple(r) for r in counts])

    pieces_swept = swept.where(F.col("kind") == PIECE)
    opens = F.lit(False).alias("opens")
    placed = pieces_swept.where("mate IS NOT NULL").select("id", "length", F.col("mate").alias("gap"), opens)
    left = pieces_swept.where("mate IS NULL").select("part", "id", "length", "place")
    if borrowed:
        lent = F.broadcast(spark.createDataFrame(borrowed, "part int, first long, last long, lender int, slots long"))
        taken = left.join(lent, "part").where("place >= first AND place < last")
        wanted = taken.select("id", "length", F.col("lender").alias("part"), (F.col("slots") - 1 - (F.col("place") - F.col("first"))).alias("place"))
        lenders = swept.where(F.col("kind") == SLOT).select("part", "place", F.col("id").alias("gap"))
        placed = placed.unionByName(wanted.join(lenders, ["part", "place"]).select("id", "length", "gap", opens))
    if opened:
        fit = capacity // up_to
        starts = F.broadcast(spark.createDataFrame(opened, "part int, first long, rank long"))
        number = F.col("rank") + F.col("place") - F.col("first")
        fresh = left.join(starts, "part").where("place >= first").withColumn("number", number)
        placed = placed.unionByName(fresh.select("id", "length", (F.floor(F.col("number") / fit) + next_gap).alias("gap"), (F.col("number") % fit == 0).alias("opens")))
        next_gap += -(-rank // fit)
    return _written(placed, "placed", count), next_gap


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(id, length, gap)``: a sequence ``gap`` for each of the written ``pieces`` ``(id, length)`` shorter than ``capacity``."""
    spark = pieces.sparkSession
    ranges = classes(capacity)
    which = F.coalesce(*[F.when(F.col("length") > above, F.lit(k)) for k, (above, _) in enumerate(ranges)])
    counts = {r[0]: r[1] for r in pieces.groupBy(which.alias("class")).count().collect()}
    gaps = spark.createDataFrame([], "gap long, free int")
    placed, next_gap = spark.createDataFrame([], "id long, length int, gap long"), 0
    for k, (above, up_to) in enumerate(ranges):
        if k not in counts:
            continue
        own = pieces.where((F.col("length") > above) & (F.col("length") <= up_to))
        here, next_gap = place_class(own, counts[k], gaps, above, up_to, capacity, next_gap)
        placed = placed.unionByName(here.drop("opens"))
        change = F.when(F.col("opens"), F.lit(capacity)).otherwise(0) - F.col("length")
        changes = gaps.unionByName(here.select("gap", change.alias("free")))
        gaps = _written(changes.groupBy("gap").agg(F.sum("free").cast("int").alias("free")).where("free > 0"), "gaps", next_gap)
    return placed


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces``, which have a ``length`` of 1 to ``capacity``, with a ``sequence_id`` and their ``offset`` in that sequence.

    Offsets leave no gap, and no sequence is longer than ``capacity``. Other columns are carried along.
    """
    clashing = [c for c in pieces.columns if c.lower() in ("row_id", "gap", "sequence_id", "offset")]
    if clashing:
        raise ValueError(f"columns {clashing} of the pieces would be replaced")
    stored = materialize(pieces.withColumn("row_id", F.monotonically_increasing_id()), "pieces")
    short = stored.where(F.col("length") < capacity).select(F.col("row_id").alias("id"), "length")
    placed = place_pieces(short, capacity).select(F.col("id").alias("row_id"), "gap")
    joined = stored.join(placed, "row_id", "left").withColumn("sequence_id", F.coalesce("gap", -1 - F.col("row_id")))
    before = F.sum("length").over(_within_sequence()) - F.col("length")
    return joined.withColumn("offset", before.cast("long")).drop("row_id", "gap")


def _within_sequence():
    from pyspark.sql import Window

    return Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "row_id").rowsBetween(Window.unboundedPreceding, 0)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids)``: the token ids of each sequence of :func:`pack`, whose pieces carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return joined.select("sequence_id", "length", ids.alias("ids"))


def op13_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = token_pieces(docs, public_vocabulary()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
