"""Fill-in-middle transformation, with cuts found in an indexable skip list.

A text is a list of units: code points, or the matches of a pattern from left to right. Two draws choose the unit ranks
of the cuts. The units stand in the lowest lane of a skip list, and every lane above it has one link for ``STRIDE`` links
below. A link carries two widths, the units and the code points it skips. A search starts in the highest lane, follows
links while the sum of their unit widths stays within the rank, goes down a lane, and so on; the code-point widths
it passed add up to the exact place of the cut in the text. A cut therefore costs a few links in each of logarithmically many lanes.

Only two numbers a text come back from Python; the pieces are cut and joined by Spark's own functions. Nothing is shuffled.

Defined results: null and empty texts stay plain and empty; a row with a null id draws as if its id were the empty string;
repeated rows give equal results; an empty table gives an empty result. Texts that hold one of the three marks stay plain, so
that every output can be undone by :func:`restored`. Whole texts are read. All columns of the input stay, and the added
ones get names that the input does not have.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commsim.llm.columns import spare

STRIDE = 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED = 90  # of 100 texts
SUFFIX_FIRST = 20  # of 100 transformed texts
PLAIN, PSM, SPM = "plain", "psm", "spm"


class SkipList:
    """Lanes of links with unit widths and code-point widths, over units of the given code-point widths."""

    def __init__(self, widths: np.ndarray):
        chars = widths.astype(np.int64 if widths.dtype.itemsize > 4 else widths.dtype)
        units = np.ones(len(widths), np.uint8)
        self.lanes = [(units, chars)]
        while len(units) > STRIDE:
            starts = np.arange(0, len(units), STRIDE)
            units = np.add.reduceat(units, starts, dtype=np.int64)
            chars = np.add.reduceat(chars, starts, dtype=np.int64)
            self.lanes.append((units, chars))

    def offset(self, rank: int) -> int:
        """The code points before the unit of ``rank``; ``rank`` may be the number of units."""
        passed = place = link = 0
        for units, chars in reversed(self.lanes):
            end = len(units)
            while link < end:
                step = int(units[link])
                if passed + step > rank:
                    break
                passed += step
                place += int(chars[link])
                link += 1
            link *= STRIDE
        return place


def unit_widths(text: str, unit: re.Pattern | None) -> np.ndarray:
    """The code points of each unit; what stands between two matches belongs to the earlier one, or else to the first."""
    if unit is None:
        return np.ones(len(text), np.uint8)
    starts = [m.start() for m in unit.finditer(text) if m.end() > m.start()]
    if not starts:
        return np.array([len(text)] if text else [], np.int64)
    starts[0] = 0
    return np.diff(np.array([*starts, len(text)], np.int64))


def cuts(text: Column, first: Column, second: Column, unit: str | None = None) -> Column:
    """``{n_units, low, high}``: the code-point places of the cuts at the ranks ``first % (n_units + 1)`` and ``second % (n_units + 1)``."""

    @F.pandas_udf("n_units long, low long, high long")
    def place(texts: pd.Series, firsts: pd.Series, seconds: pd.Series) -> pd.DataFrame:
        pattern = re.compile(unit) if unit else None
        rows = []
        for text, a, b in zip(texts, firsts, seconds):
            widths = unit_widths(text, pattern)
            lanes, n = SkipList(widths), len(widths)
            low, high = sorted((int(a) % (n + 1), int(b) % (n + 1)))
            rows.append((n, lanes.offset(low), lanes.offset(high)))
        return pd.DataFrame(rows, columns=["n_units", "low", "high"])

    return place(F.coalesce(text, F.lit("")), first, second)


def draws(key: Column, number: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the SHA-256 of a key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(number)]


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", unit: str | None = None, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """``docs`` with ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of their ``text``.

    ``transformed`` of 100 texts get their middle moved to the end, ``suffix_first`` of 100 of these with the suffix before
    the prefix. ``unit`` is a pattern of units; without one, units are code points.
    """
    names = {c: spare(docs, c) for c in ("text_", "draw1", "draw2", "form", "cut", "prefix_chars", "middle_chars", "output")}
    text, form, cut = names["text_"], names["form"], names["cut"]
    first, second, third, fourth = draws(docs[key])
    marked = F.contains(F.col(text), F.lit(PREFIX)) | F.contains(F.col(text), F.lit(SUFFIX)) | F.contains(F.col(text), F.lit(MIDDLE))
    plain = (F.col(text) == "") | marked | (third % 100 >= transformed)
    chosen = F.when(plain, PLAIN).when(fourth % 100 < suffix_first, SPM).otherwise(PSM)
    low, high = F.col(cut)["low"].cast("int"), F.col(cut)["high"].cast("int")
    prefix, middle = F.substr(F.col(text), F.lit(1), low), F.substr(F.col(text), low + 1, high - low)
    suffix = F.substr(F.col(text), high + 1)
    is_plain = F.col(form) == PLAIN
    output = (
        F.when(is_plain, F.col(text))
        .when(F.col(form) == PSM, F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    ready = docs.withColumns({text: F.coalesce(docs["text"], F.lit("")), names["draw1"]: first, names["draw2"]: second})
    ready = ready.withColumns({form: chosen, cut: cuts(F.col(text), F.col(names["draw1"]), F.col(names["draw2"]), unit)})
    made = {names["prefix_chars"]: F.when(~is_plain, low.cast("long")), names["middle_chars"]: F.when(~is_plain, (high - low).cast("long"))}
    return ready.withColumns({**made, names["output"]: output}).drop(text, names["draw1"], names["draw2"], cut)


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made: no mark occurs in its pieces, nor can one arise where they meet."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    second = F.when(form == PSM, F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    head, rest = F.split_part(body, second, F.lit(1)), F.split_part(body, second, F.lit(2))
    tail, middle = F.split_part(rest, F.lit(MIDDLE), F.lit(1)), F.split_part(rest, F.lit(MIDDLE), F.lit(2))
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs)
    return made.select(
        "doc_id",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
    FROM documents
), numbers AS (
    SELECT *, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
        CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4
    FROM drawn
), formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), cut AS (
    SELECT *, substring(t, 1, low) AS prefix, substring(t, low + 1, high - low) AS middle, substring(t, high + 1) AS suffix FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM cut
"""
