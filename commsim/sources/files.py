"""File formats: posts, components, baskets, word and name lists, metadata, pair scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commsim.functions.strings import strip_non_ascii
from commsim.operators.index import number_rows
from commsim.session import materialize


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, LONG, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()

POSTS = _schema(subreddit=STRING, title=STRING, author=STRING)
COMPONENTS = _schema(subreddit=STRING, index=LONG)
BASKET = _schema(author=STRING, communities=T.ArrayType(STRING))
METADATA = _schema(name=STRING, affixes=STRING, mods=STRING, mentions=STRING)
SCORES = _schema(s1=STRING, s2=STRING, score=DOUBLE)
TEXT_SCORES = _schema(s1=STRING, s2=STRING, ngram=DOUBLE, user=DOUBLE)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; the explicit schema saves the inference pass over the data."""
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_lines(spark: SparkSession, path: str, name: str = "name", trim: bool = True) -> DataFrame:
    """One value per non-empty line, such as an allow-list; ``trim=False`` keeps spaces, as affixes need."""
    value = F.trim("value") if trim else F.col("value")
    return spark.read.text(path).select(value.alias(name)).where(F.col(name) != "")


def write_lines(df: DataFrame, path: str) -> None:
    df.write.text(path)


def read_words(spark: SparkSession, path: str, name: str = "word") -> DataFrame:
    """Distinct whitespace-separated words of a text file."""
    words = spark.read.text(path).select(F.explode_outer(F.split("value", r"\s+")).alias(name))
    return words.where(F.col(name) != "").distinct()


def write_baskets(baskets: DataFrame, path: str) -> None:
    """Author baskets as one JSON object per text line."""
    baskets.select(F.to_json(F.struct("author", "communities")).alias("value")).write.text(path)


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    """Transactions: the communities of each basket, without its author."""
    parsed = spark.read.text(path).select(F.from_json("value", BASKET).alias("basket"))
    return parsed.select(F.col("basket.communities").alias("communities"))


def write_metadata(metadata: DataFrame, path: str, order: str | None = None) -> None:
    """Name and three ``|``-joined lists as CSV without header; moderators and mentions become ASCII.

    The lines follow the column ``order``, which is not written, over the folder's files by name.
    """
    ordered = metadata if order is None else metadata.orderBy(order)
    ordered.select(
        "name", "affixes", strip_non_ascii(F.col("mods")).alias("mods"), strip_non_ascii(F.col("mentions")).alias("mentions")
    ).write.csv(path)


def read_metadata(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    """Metadata rows with properly quoted fields; an absent list is the empty string. ``placed`` adds each line's ``place``."""
    rows = spark.read.schema(METADATA).csv(path)
    return (number_lines(rows) if placed else rows).na.fill("")


def number_lines(rows: DataFrame, place: str = "place") -> DataFrame:
    """The rows of text files with their ``place``, from 0 on: files follow each other by name, and lines as they stand.

    ``rows`` is a file scan as it was read. A file is read in splits by many tasks; each row is written with its split's file and
    first byte and its turn in the task, and only the number of rows of each split goes to the driver.
    """
    turn = F.monotonically_increasing_id().alias("turn_")
    split = [F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("begin_")]
    stored = materialize(rows.select("*", *split, turn), "lines")
    splits = stored.groupBy("file_", "begin_").agg(F.min("turn_").alias("first_"), F.count("*").alias("n")).orderBy("file_", "begin_").collect()
    starts, total = [], 0
    for r in splits:
        starts.append((r.file_, r.begin_, total - r.first_))
        total += r.n
    shifts = rows.sparkSession.createDataFrame(starts, "file_ string, begin_ long, shift_ long")
    placed = stored.join(F.broadcast(shifts), ["file_", "begin_"]).withColumn(place, F.col("turn_") + F.col("shift_"))
    return placed.select(*rows.columns, place)


def read_pair_scores(spark: SparkSession, path: str, schema: T.StructType = SCORES) -> DataFrame:
    """Pair scores as JSON lines."""
    return spark.read.schema(schema).json(path)


def write_score_array(scores: DataFrame, path: str, *order: str) -> None:
    """Pair scores as one file that holds one JSON array, its elements in ``order``; columns of ``order`` alone are not written.

    The format keeps the report of a given list in one file, so one task writes it.
    """
    fields = [c for c in scores.columns if c not in order or c in ("s1", "s2")]
    numbered = number_rows(scores.withColumn("order_", F.struct(*order)), "order_", "place_")
    first, last = F.col("place_") == 0, F.col("place_") == numbered.size - 1
    line = F.concat(F.when(first, "[").otherwise(","), F.to_json(F.struct(*fields)), F.when(last, "]").otherwise(""))
    lines = numbered.frame.select("place_", line.alias("value"))
    if not numbered.size:
        lines = scores.sparkSession.createDataFrame([(0, "[]")], "place_ long, value string")
    lines.repartition(1).sortWithinPartitions("place_").select("value").write.text(path)


def read_score_arrays(spark: SparkSession, path: str, schema: T.StructType = SCORES, order: str = "ord") -> DataFrame:
    """Pair scores of files that hold one JSON array each, with their place in the array as ``order``."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(schema)).alias("entries"))
    return whole.select(F.posexplode("entries").alias(order, "entry")).select("entry.*", order)
